"""Queries on whole small tables against plain Python and DuckDB."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.components import connected_components
from millrace.llm.embedding_dedup import embedding_near_duplicates
from millrace.llm.oracles import ORACLES
from millrace.llm.packing import Genetics, _encoding, best_fit, crossover, evolve, fills_of
from millrace.llm.queries import QUERIES
from millrace.llm.secrets import ALPHABET, MarkovSettings, scan_secrets, train_markov
from millrace.llm.simhash import fingerprint, fingerprint_links
from millrace.llm.token_count import Encoder, spliced_count
from test_similarity import kept_by_all_pairs

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    held = texts(spark)
    assert all(fingerprint(t) == slow_fingerprint(t) for t in [*held.values(), None, "", "A", "a B", "a\x0bb\x1cc d e"])


def test_simhash_query(spark):
    held = texts(spark)
    ids = sorted(held)
    fps = [slow_fingerprint(held[i]) for i in ids]
    roots = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    want = sorted((d, f"{f:016x}", ids[r]) for d, f, r in zip(ids, fps, roots, strict=True))
    assert sorted(map(tuple, QUERIES["op3_simhash_dedup"](spark, SF).collect())) == want


def test_links_are_all_found(spark, rows):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for base in list(fps):
        for _ in range(25):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1, 1 << 63, 3 << 62}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = sorted(((min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2), key=repr)
    assert rows(fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 1)]
    root = components(600, [e for e in edges if e[0] is not None])
    want = {i: root[i] for e in edges if e[0] is not None and e[0] != e[1] for i in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("chunk", [16, 2048])
def test_embeddings(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    near = np.concatenate([b + rng.normal(size=(12, 64)) * rng.choice([0.02, 0.2, 0.3, 0.4]) for b in base])
    x = np.concatenate([base, near, near[:30] * 3, near[:30]]).astype(np.float32)
    labels = [int(i) for i in rng.integers(0, 2, len(x))]
    df = spark.createDataFrame([(i, v.tolist(), lb) for i, (v, lb) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(i, j) for i in range(len(x)) for j in range(i) if labels[i] == labels[j] and u[i] @ u[j] >= 0.93]
    count = np.bincount(np.array(links).ravel(), minlength=len(x))
    root = components(len(x), links)
    assert len(links) > 300
    assert sorted(map(tuple, embedding_near_duplicates(df, 0.93, chunk_rows=chunk).collect())) == [(i, int(count[i]), root[i], root[i] == i) for i in range(len(x))]


def test_embeddings_of_the_tables(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    u = np.stack(t.embedding).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    same = (u @ u.T >= 0.93) & (t.label.to_numpy()[:, None] == t.label.to_numpy()[None, :])
    np.fill_diagonal(same, False)
    got = QUERIES["op4_embedding_dedup"](spark, SF).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == same.sum(axis=1).tolist()


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.lang == got.lang_pred).mean() > 0.95


def test_languages_against_exact_sets(spark):
    """The same learning with sets of n-grams in plain Python: filters may only add what they take for known by chance."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain = lambda t: b" " + regex.sub(r"[^\p{L}\p{M}]+", " ", t.lower()).strip().encode() + b" "
    grams = lambda b: [b[i : i + n] for n in (3, 4, 5) for i in range(len(b) - n + 1)]
    counts = {}
    for lang, text in {(r.lang, r.text) for r in docs.values() if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}:
        counts.setdefault(lang, Counter()).update(grams(plain(text)))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, p in share[lang].items() if counts[lang][g] >= 3 and p >= 0.35 * max(s.get(g, 0) for s in share.values())} for lang in counts}
    got, agreed, n = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}, 0, 0
    for d, r in docs.items():
        if not r.text or not regex.search(r"\p{L}", r.text):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        of = grams(plain(r.text))
        known = {lang: sum(g in s for g in of) / len(of) for lang, s in held.items()}
        n += 1
        agreed += got[d].lang_pred == max(known, key=known.get)
        assert abs(got[d].score - known[got[d].lang_pred]) < 0.05
    assert agreed >= 0.99 * n > 100


def test_token_query(spark):
    """Every whole text of the table by the library itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    held = texts(spark)
    n = {d: len(model.encode(t or "")) for d, t in held.items()}
    want = sorted((d, len((t or "").encode()), n[d], n[d] > 4096) for d, t in held.items())
    assert sorted(map(tuple, QUERIES["op6_token_counts"](spark, SF).collect())) == want


def test_splices(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "a", "bc", "the ", "\n", "é", "😀", "日本", "ﬁ", "1", "'s", "\t", "x" * 70]
    for path in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        encoder = Encoder(public_tokenizers.path(path))
        for _ in range(120):
            t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
            assert [spliced_count(t, encoder, c, o) for c, o in ((40, 4), (64, 16), (100, 1))] == encoder.count([t]) * 3


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op7_html_extraction"](spark, SF).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<(/?)(\w+)[^>]*>", lambda m: " " if m[2] in ("p", "h1", "br") else "", article)).split())
        assert r.text == want and r.n_chars == len(want)


def test_secrets_base(spark):
    held = texts(spark)
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"""(?:{word}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in QUERIES["op9_secret_scans"](spark, SF).collect():
        t = held[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert hashlib.sha256(joined.encode()).hexdigest() == r.base_sha256
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == s[1] for s in spans) for k in (0, 1, 2)]


def test_secret_spans(spark):
    """All spans by a plain scan: what assignments leave of runs of token characters, apart from base spans, by the mean ratio."""
    held = texts(spark)
    settings = MarkovSettings()
    ratios = train_markov(spark.read.parquet(f"{SF}/documents.parquet"), settings)
    named = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    def ratio(t):
        pairs = [ratios[ALPHABET.index(a) * len(ALPHABET) + ALPHABET.index(b)] for a, b in zip(t, t[1:], strict=False)]
        told = [x for x in pairs if x]
        return sum(told) / max(1, len(told))
    n = 0
    for r in QUERIES["op9_secret_scans"](spark, SF).collect():
        t = held[r.doc_id] or ""
        base = [(m.start(), 0, m.end()) for m in named.finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", t)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", t)]
        rest = named.sub(lambda m: " " * len(m[0]), t)
        more = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", rest) if not any(a < m.end() and m.start() < b for a, _, b in base) and any(len(p) >= 20 and ratio(p) >= 2 for p in [m[0], *re.split(r"[+/_=-]+", m[0])])]
        n += len(more)
        assert r.spans == ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in sorted(base + more)), r.doc_id


def test_secrets_by_model(spark):
    rng = random.Random(9)
    drawn = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for n in (24, 32, 40, 36) * 10]
    plain = ["internationalization_of_documents", "get-customer-by-identifier", "one/two/three/four/five/six", "antidisestablishmentarianism", "thereerandthenheretion"] * 8
    prose = " ".join(t for t in texts(spark).values())[:200_000]
    data = [(i, f"see {t} here. {prose[i * 2000 : i * 2000 + 2000]}") for i, t in enumerate(drawn + plain)] + [(1000 + i, f'token = "{rng.getrandbits(160):040x}"') for i in range(30)]
    got = {r.doc_id: [x for x in r.spans if x.kind == 3] for r in scan_secrets(spark.createDataFrame(data, "doc_id int, text string"), MarkovSettings()).collect()}
    caught = [i for i, t in enumerate(drawn) if any(x.start == 4 and x.stop == 4 + len(t) for x in got[i])]
    assert len(caught) >= 0.95 * len(drawn) and not any(x.start == 4 for i in range(len(drawn), len(drawn + plain)) for x in got[i])


def test_packing(spark):
    from tokenizers import Tokenizer

    held = texts(spark)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in held.items()}
    got = QUERIES["op10_best_fit_packing"](spark, SF).toPandas()
    assert len(got) == len(got.groupby(["doc_id", "piece"]))
    for d, part in got.sort_values("piece").groupby("doc_id"):
        at = 0
        for r in part.itertuples():
            assert r.start == at and zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[d]) and (len(part) == 1 or (part.length.iloc[1:] == 2048).all())
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= 1.01 * -(-fill.sum() // 2048) + 1


def test_genetics():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(200, 1200, 300))[::-1].copy()
    first, second = [], []
    for order, out in ((np.arange(300), first), (rng.permutation(300), second)):
        bins, room = np.full(300, -1, np.int64), []
        best_fit(lengths, order, bins, room, 2048)
        out.append(bins)
    child = crossover(lengths, first[0], second[0], 2048, rng)
    assert (child >= 0).all() and fills_of(lengths, child).max() <= 2048
    best = evolve(lengths, [], 2048, Genetics(generations=30), [1])[0]
    assert fills_of(lengths, best).max() <= 2048 and (fills_of(lengths, best) > 0).sum() <= (fills_of(lengths, first[0]) > 0).sum()


def test_genetics_gain_on_hard_lengths():
    """Where no two and hardly three documents fill a sequence, the generations save sequences that best fit needs."""
    lengths = np.sort(np.random.default_rng(8).integers(600, 901, 1024))[::-1].copy()
    bins = np.full(1024, -1, np.int64)
    best_fit(lengths, np.arange(1024), bins, [], 2048)
    evolved = evolve(lengths, [], 2048, Genetics(generations=40), [2])[0]
    assert fills_of(lengths, evolved).max() <= 2048 and (fills_of(lengths, evolved) > 0).sum() < (fills_of(lengths, bins) > 0).sum()


def test_token_ids_are_the_librarys():
    """The ids of operator 10 for every code point, alone and between letters, and for special strings."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), _encoding(path)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    lines = ["".join(points[i : i + 400]) for i in range(0, len(points), 400)] + ["a".join(points[i : i + 400]) for i in range(0, len(points), 400)]
    lines += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " \n \n\n  x  ", "don't we'll I'VE 12345 ½²", ""]
    for line, want in zip(lines, library.encode_batch(lines, add_special_tokens=False), strict=True):
        assert ours.encode(line, allowed_special="all") == want.ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        frames.append(docs.toPandas())
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    known, distinct, clean, mixed, packed = frames
    want = set(kept_by_all_pairs(list(zip(known.doc_id, known.text, strict=True))))
    assert sorted(distinct.doc_id) == sorted(want)
    assert set(clean.doc_id) == want and not clean.text.str.contains(r"[0-9a-f]{24}").any() and (clean.n_chars == clean.text.str.len()).all()
    words = lambda f: f.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert abs(words(mixed).sum() - 1.5 * words(clean).sum()) <= len(clean.source.unique()) and set(mixed.doc_id) <= want
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and sorted(packed[packed.piece == 0].doc_id) == sorted(mixed.doc_id)


def test_held_out_flag(spark):
    got = QUERIES["op5_language_id"](spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert spark.range(1).select(F.crc32(F.lit("7").cast("binary"))).first()[0] == zlib.crc32(b"7")
