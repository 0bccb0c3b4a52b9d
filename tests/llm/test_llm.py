"""Each operator against a brute-force version, on a small table and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from terraql.llm import byte_bpe, language_id, license_scan, mixing, multi_index, queries, simhash, suffix_dedup, token_counts, top_k, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def order(items):
    return sorted(items, key=repr)


# --- op 1


def test_urls_follow_the_rules(spark, data):
    got = queries.op1_url_filter(spark, data).toPandas().sort_values("page_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = con.sql(queries.URL_SQL).df().sort_values("page_id").reset_index(drop=True)
    assert got.astype(object).where(got.notna(), None).equals(want[got.columns].astype(object).where(want.notna(), None))


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_top_k"])
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, data).select(*want.columns)
    assert order(rows(got)) == order(want.fetchall())


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://NET/", "x://net", "x://net?a/", "x://anet/", "x://a.NET/b?c#d", "x://É.Example.NET/en/" + "y" * 5000, "x://example.net/en", "x://example.com/de/a/../b", "x://o.org/fr/", "x://a.adult-x.example.org/", "a://b://c/d", "x://evil.com/.net/", "x://net/\n/z"]
    table = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    got = url_filter.judge(table, queries.RULES, queries.GLOBS).orderBy("page_id").collect()
    for r in got:
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = re.match(r"(?s)[^?#]*", tail)[0]
        fit = [x for x in queries.RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith("/" + p))(*x.pattern.split("/", 1))]
        rule = max(fit, key=lambda x: len(x.pattern)) if fit else None
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.pattern), url
        assert r["verdict"] == (rule.verdict if rule else "block" if "adult" in host else "allow")
    assert url_filter.judge(table.limit(0), queries.RULES, []).count() == 0


def test_globs_span_words_of_bits():
    globs = ["*.b/**", "a?c", "**x**", "a*c/d**", *(f"p{i}*q{i}**end" for i in range(40))]
    texts = [b"z.b/", b"a/b.b/", b"abc", b"a/c", b"x", b"", b"abbc/d", b"a/c/d", *(f"p{i}..q{i}/end".encode() for i in range(40)), b"p1/q1end"]
    as_regex = [re.compile(re.sub(r"\\\*\\\*", ".*", re.escape(g)).replace(r"\*", "[^/]*").replace(r"\?", "[^/]"), re.S) for g in globs]
    want = [[bool(r.fullmatch(t.decode())) for r in as_regex] for t in texts]
    assert url_filter.Automaton(globs).matches(texts).tolist() == want


# --- op 2


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=4):
    prints = [f for _, f in pairs]
    label = list(range(len(prints)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(pairs):
        r = find(i)
        least[r] = d if least[r] is None or (d is not None and d < least[r]) else least[r]
    return [(d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(pairs)]


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_near_duplicates(request, which):
    table = request.getfixturevalue(which)
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in table.collect()])
    got = rows(simhash.near_duplicates(table).drop("text_hash"))
    assert order(got) == order(want)


def test_hot_buckets_are_cut_into_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 3), dtype=np.uint64), axis=1) for b in base]))
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = brute_components(list(enumerate(prints.tolist())))
    for tile in (8, 8192):
        found = rows(simhash.links(table, 4, len(prints), tile))
        place = {int(x): i for i, x in enumerate(prints.view(np.int64))}
        label = simhash.forest(np.array([place[u] for u, _ in found]), np.array([place[v] for _, v in found]), len(prints))
        assert label.tolist() == [c for _, _, c in want]


def test_more_blocks_find_the_same_links():
    for n in (1, (1 << 26) + 1, (1 << 33) + 1):
        blocks, agree = simhash.blocks_for(n, 4)
        assert blocks - agree == 4


def test_one_of_each_group_stays(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in odd_docs.collect()])
    assert kept.count() == len({(c, f) if c is None else c for _, f, c in groups})


# --- op 3


def test_licences(spark, docs, odd_docs, no_docs):
    table = spark.createDataFrame([(1, "words\nRELEASED under the MIT Licence!\nReleased under the MIT License."), (2, "Copyright (c) 2020 Someone\nLicensed under the Apache License, Version 2.0"), (3, "not Released under the MIT License."), (4, None), (5, "")], "doc_id long, text string")
    assert order(rows(license_scan.license_scan(table))) == [(1, "MIT", 2, False), (2, "Apache-2.0", 1, True)]
    assert rows(license_scan.license_scan(odd_docs)) == rows(license_scan.license_scan(no_docs)) == []
    want = Counter((r["doc_id"], name) for r in docs.collect() for line in (r["text"] or "").split("\n") for name, text in license_scan.KNOWN[:1] + license_scan.KNOWN[5:11] if line == text)
    assert {r[:2] for r in rows(license_scan.license_scan(docs))} == set(want)


def test_licences_in_texts_of_any_length(spark):
    notice, isc = "Released under the MIT License.", next(text for name, text in license_scan.KNOWN if name == "ISC")
    owners = "".join(f"Copyright (c) {1900 + i} The Holder Number {i} and Contributors\n" for i in range(100))
    banner = ("/" + "*" * 78 + "/\n") * 100
    texts = [owners + isc, banner + isc + "\n" + banner, "some words\n" + "*" * 5000 + " " + notice + " " + "-" * 5000, " " * 9000 + notice, "\n" * 300_000 + notice, "words " * 2000 + notice, "\n *\n * " * 2000 + owners + notice]
    got = rows(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert order(got) == [(0, "ISC", 1, True), (1, "ISC", 1, True), (2, "MIT", 1, False), (3, "MIT", 1, True), (4, "MIT", 1, True), (6, "MIT", 1, True)]


def test_full_licences(spark):
    """Each full text, as it is and in changed case, punctuation, wrapping and copyright lines."""
    import textwrap
    from pathlib import Path

    folder = Path(license_scan.__file__).with_name("licenses")
    full = {path.stem: path.read_text("utf-8") for path in folder.glob("*.txt")}
    assert {"MIT", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "CC0-1.0"} == set(full)
    full["BSD-2-Clause"] = full["BSD-3-Clause"].split("3.  Neither")[0] + "THIS SOFTWARE" + full["BSD-3-Clause"].split("THIS SOFTWARE", 1)[1]
    owners = "".join(f"// Copyright (c) {1990 + i} Someone {i}\n" for i in range(30))

    def changed(text):
        parts = [textwrap.wrap(" ".join(part.split()), 64) for part in text.split("\n\n") if not part.strip().lower().startswith("copyright (c)")]
        return owners + "/*\n" + "\n *\n".join(" ** " + "\n ** ".join(part) for part in parts).upper().replace(",", " ,") + "\n */\n"

    plain = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC0-1.0"]
    texts = [(name, text) for name, text in full.items()]
    texts += [(name, changed(full[name])) for name in plain]
    texts += [(name, full[name].upper().replace("\n", "\r\n # ")) for name in full]
    texts += [("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + full["MIT"]), ("BSD-3-Clause", "Copyright 2020, A\nAll rights reserved.\n\n" + full["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    texts += [("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 The Authors")), ("Apache-2.0", full["Apache-2.0"].split("END OF TERMS")[0])]
    texts += [(None, full["MIT"] + "and more"), (None, full["GPL-3.0-only"][:-300])]
    found = rows(license_scan.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")))
    whole = {i: name for i, name, _, is_whole in found if is_whole}
    assert whole == {i: name for i, (name, _) in enumerate(texts) if name}


# --- op 4 and 7


ODD_TEXTS = ["", "Σσς ΑΣ İI <|endoftext|>foo <|startoftext|>\u0301x", "é café ½ ①     x's don't", "a" * 301, "日本語テキスト 123 4567", "\x00\x01 \x85 ", "ﬁ ǅ ŉ", "\U0001e6c0a\u0558b\U0001246f1", " \n\n  x  \t y"]


def random_texts():
    rng = np.random.default_rng(5)
    spans = [(32, 127), (0x80, 0x2FFF), (0x3000, 0xD7FF), (0x10000, 0x1FFFF)]
    return ["".join(chr(rng.integers(*spans[rng.integers(4)])) for _ in range(120)) for _ in range(150)]


def test_counts_as_the_library(docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    texts = ODD_TEXTS + random_texts()
    assert token_counts.WordCounter(path).count(texts) == [count(t) for t in texts]
    for table in (docs, odd_docs, no_docs):
        got = token_counts.token_counts(table.select("doc_id", "text"), path).collect()
        assert all((r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), count(r["text"])) and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
        assert len(got) == table.count()


def test_long_texts_are_counted_in_pieces(monkeypatch):
    from terraql.llm import split

    path = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(random_texts())
    whole = token_counts.WordCounter(path).count([text])
    monkeypatch.setattr(split, "PIECE", 64)
    assert token_counts.WordCounter(path).count([text]) == whole


def test_ids_as_the_library(docs, odd_docs, no_docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    texts = ODD_TEXTS + random_texts()
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    assert codec.encode(texts) == [ids(t) for t in texts]
    assert [codec.decode(x).decode() for x in codec.encode(texts)] == texts
    assert all(np.array(codec.one(w.encode()), "<u4").tobytes() == ids(w) for w in ("internationalization", "aaaaaaa"))
    for table in (docs, odd_docs, no_docs):
        got = byte_bpe.round_trip(table.select("doc_id", "text"), path, public_tokenizers.PATTERN).collect()
        assert len(got) == table.count()
        for r in got:
            packed, raw = ids(r["text"]), (r["text"] or "").encode()
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(odd_docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both)


def test_pairs_that_fall_in_rank(tmp_path):
    """A vocabulary in which a merge can make a pair of a lower rank."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abcd", b"cd", b"ab", b"bcd", b"xab", b"aa", b"aaaa", b"aaa"]
    path = tmp_path / "r.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    codec = byte_bpe.Codec(str(path), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abcdx"), 9).tolist()) for _ in range(300)] + [b"a" * n for n in range(1, 12)]
    ids, count = codec.replay(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [codec.one(w) for w in words]


# --- op 5 and 8


VECTORS = [(0, [0.5, -0.25]), (100, [0.1, 0.9]), (200, None), (300, [float("nan"), 1.0]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (None, [1.0, 1.0]), (3, [None, 1.0]), (4, []), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("inf"), 0.0]), (100, [0.1, 0.9]), (8, [-3.0, 7.5]), (400, [1.0, 2.0, 3.0]), (9, [2.0, 2.0, 2.0])]


def brute_nearest(table, modulus, k, score, usable):
    found = [(i, np.array(v, float)) for i, v in table if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and usable(v)]
    asked = {}
    for i, v in found:
        if i % modulus == 0 and (i not in asked or v.tolist() < asked[i].tolist()):
            asked[i] = v
    out = []
    for q, v in asked.items():
        near = sorted(((-score(v, w), i) for i, w in found if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return order(out)


def test_exact_top_k(spark, data):
    floor = lambda v: np.floor(1024 * v).astype(np.int64)
    product = lambda v, w: int(floor(v) @ floor(w))
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert order(rows(queries.op5_top_k(spark, data))) == brute_nearest(table, 100, 10, product, lambda v: True)
    odd = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    assert order(rows(top_k.top_k(odd, 100))) == brute_nearest(VECTORS, 100, 10, product, lambda v: True)
    assert top_k.top_k(odd.limit(0), 100).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    large = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 6)).tolist()) for i in range(400)]
    large += [(1000, [32768.0, 1.0]), (1100, [-0.5, 40000.25]), (1001, [2.0**18, -(2.0**18)]), (1002, [0.001, 3e5]), (1003, [2.0**17, 2.0**17]), (1200, [2.0**18, 2.0**17])]
    floor = lambda v: [int(x) for x in np.floor(1024 * v)]
    product = lambda v, w: sum(a * b for a, b in zip(floor(v), floor(w), strict=True))
    table = spark.createDataFrame(large, "vec_id long, embedding array<double>").repartition(3)
    got = order(rows(top_k.top_k(table, 100)))
    assert got == brute_nearest(large, 100, 10, product, lambda v: True)
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", large)
    assert got == order(con.sql(queries.TOP_K_SQL).fetchall())


def test_top_k_of_scores_around_a_long(spark):
    """Partial sums and scores of lower ranks may pass a long; a score of the k highest may not."""
    huge = [(0, [2.0**40, 2.0**40, 1.0]), (1, [2.0**40, -(2.0**40), 3.0]), (2, [-1e30, 0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (100, [0.0, 0.0, 1e25]), (4, [-(2.0**60), 2.0**60, 0.0])]
    floor = lambda v: [int(x) for x in np.floor(1024 * v)]
    product = lambda v, w: sum(a * b for a, b in zip(floor(v), floor(w), strict=True))
    table = spark.createDataFrame(huge, "vec_id long, embedding array<double>").repartition(4)
    zero = [r for r in huge if r[0] != 100]
    assert order(rows(top_k.top_k(table.where("vec_id <> 100"), 100, k=3))) == brute_nearest(zero, 100, 3, product, lambda v: True)
    with pytest.raises(Exception, match="doesn't fit a long"):
        top_k.top_k(table, 100, k=5).collect()


def test_bit_slices_find_ties():
    rng = np.random.default_rng(2)
    for spread in (2, 40, 5000):
        x = rng.integers(-spread, spread, (3000, 9))
        index = top_k.BitSlices(np.arange(3000), x)
        for q in range(5):
            found, scores = index.best(x[q], q, 10)
            full = x @ x[q]
            full[q] = -(1 << 40)
            want = np.sort(full)[::-1][9]
            assert (full[found] == scores).all() and set(np.flatnonzero(full >= want)) <= set(found.tolist())


def test_neighbours_and_recall(spark, data):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    score = lambda v, w: float((v * w).sum())
    want = brute_nearest(table, 20, 20, score, any)
    got = order(rows(queries.op8_multi_index(spark, data)))
    assert len(got) == len(want)
    recall = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)
    assert recall >= 0.9
    exact = {(q, i): s for q, _, i, s in brute_nearest(table, 20, 10**6, score, any)}
    assert all(s == exact[q, i] for q, _, i, s in got)
    odd = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    assert order(rows(multi_index.nearest_neighbours(odd, 20))) == brute_nearest(VECTORS, 20, 20, score, any)
    assert multi_index.nearest_neighbours(odd.limit(0), 20).count() == 0


def test_cells_come_by_rising_sums():
    rng = np.random.default_rng(4)
    one, two = rng.normal(size=7), rng.normal(size=5)
    sums = (one[:, None] + two[None, :]).ravel()
    assert multi_index.walk(one, two, np.ones(35, np.int64), 20) == np.argsort(sums)[:20].tolist()


# --- op 6


def brute_quotas(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats):
        given[max(range(len(votes)), key=lambda i: votes[i] / (2 * given[i] + 1))] += 1
    return given


def test_quotas_by_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes = rng.integers(1, 10_000, rng.integers(1, 12)).astype(float).tolist()
        seats = int(rng.integers(0, 400))
        assert mixing.sainte_lague(votes, seats) == brute_quotas(votes, seats)


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_mix_meets_targets(request, which):
    table = request.getfixturevalue(which)
    got = mixing.mix(table, shard_words=20_000).collect()
    assert len(got) == table.count()
    size = Counter()
    for r in table.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted([s for s in size if s is not None], key=lambda s: s.encode("utf-32-be")) + [None] * (None in size)
    left, target, live = float(sum(size.values())), {}, dict(zip(names, [1, 2, 3] * len(names), strict=False))
    while live:
        per = left / sum(live.values())
        over = [s for s, w in live.items() if w * per > 3 * size[s]]
        for s in over or list(live):
            target[s] = 3.0 * size[s] if over else live[s] * per
            left -= target[s] if over else 0
            del live[s]
    taken, seen = Counter(), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["target"], r["source_size"]] += r["taken"]
    for s in names:
        seen[target[s], size[s]] += round(target[s])
    assert {k[1]: v for k, v in taken.items()} == {k[1]: v for k, v in seen.items()} or all(abs(taken[k] - v) <= 1e-6 * (v + 1) for k, v in seen.items())
    assert order(rows(mixing.mix(table.repartition(5), shard_words=20_000))) == order([tuple(r) for r in got])


def test_mixed_documents_hold_what_is_taken(docs):
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken


# --- op 9


def brute_repeats(texts, span):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for i in range(len(raw) - span + 1):
            seen[hash(raw[i : i + span])] += 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            if seen[hash(raw[i : i + span])] > 1:
                gone[i : i + span] = b"\1" * span
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("gathered", [suffix_dedup.GATHERED, 1])
@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_repeated_bytes(request, which, gathered):
    table = request.getfixturevalue(which)
    read = table.collect()
    want = [(r["doc_id"], *x) for r, x in zip(read, brute_repeats([r["text"] for r in read], 400), strict=True)]
    assert order(rows(suffix_dedup.repeated_bytes(table, gathered=gathered))) == order(want)


@pytest.mark.parametrize("gathered", [suffix_dedup.GATHERED, 1])
def test_repeats_of_all_kinds(spark, gathered, monkeypatch):
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abcd é"), n))
    shared = [letters(n) for n in (300, 399, 400, 401, 700, 2000)]
    texts = [letters(rng.integers(0, 300)) + shared[rng.integers(6)] + letters(rng.integers(0, 300)) for _ in range(60)]
    texts += ["ab" * 700, "ab" * 450, "a" * 450, "q" * 399, "q" * 401, "abc" * 400 + letters(50) + "abc" * 300]
    edited = list(shared[5])
    edited[1000] = "#"
    texts.append("".join(edited))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = order([(i, *x) for i, x in enumerate(brute_repeats(texts, 400))])
    assert order(rows(suffix_dedup.repeated_bytes(table, gathered=gathered))) == want


def test_pieces_have_the_same_windows(monkeypatch):
    raw = bytes(np.random.default_rng(10).integers(97, 123, 5000).tolist()) + b"ab" * 600
    found = []
    for size in (1 << 20, 1000):
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        cells = [(p + f + i, h, p + a) for p, hs, anchors, first, count in suffix_dedup.cells(raw, 400, 160) for h, a, f, n in zip(hs, anchors, first, count, strict=True) for i in range(n)]
        found.append(cells)
    assert found[0] == found[1] and [w for w, _, _ in found[0]] == list(range(len(raw) - 399))


def test_repeats_across_pieces(spark):
    rng = np.random.default_rng(11)
    long = "".join(rng.choice(list("abcdefghij"), (1 << 20) + 30_000))
    cut = (1 << 20) - 300
    texts = [long, "start " + long[cut : cut + 900] + " stop", long[5:300] + "x" + long[400:900]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = order([(i, *x) for i, x in enumerate(brute_repeats(texts, 400))])
    assert order(rows(suffix_dedup.repeated_bytes(table))) == want


def test_cut_texts(odd_docs):
    got = suffix_dedup.without_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    # the blanks around the passage and the letter after it are shared too
    assert text[10] == "beforefter" and text[11] == "other wordsnd more" and 6 not in text and text[1] == ""


# --- op 10


def test_languages(docs, odd_docs, no_docs):
    got = language_id.languages(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = language_id.languages(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2, 12)} == {"und"}
    assert language_id.languages(no_docs).count() == 0
    unlabelled = language_id.languages(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r)[2:] for r in unlabelled.collect()} == {("und", 0.0)}


def test_prediction_reads_the_text_only(docs):
    model = language_id.fit(docs)
    one = docs.select("text", language_id.predicted(docs, model).alias("p")).collect()
    two = docs.select(F.lit("x").alias("lang"), "text", F.lit(0).alias("doc_id")).select("text", language_id.predicted(docs, model).alias("p")).collect()
    assert one == two


def test_counts_of_pieces_add_up(monkeypatch):
    text = "Änderung ist möglich " * 40
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert (language_id.counts(text) == whole).all()


# --- pipeline


def test_pipeline(spark, data, odd_docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "n_tokens", "token_ids"}
    assert out.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    table = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, data)
    assert table.count() > 0


def brute_passages(texts, words):
    """For each text, which of its words are in a passage that another text of the list has too."""
    split = [WORD.findall(t or "") for t in texts]
    seen = defaultdict(set)
    for i, own in enumerate(split):
        for at in range(len(own) - words + 1):
            seen[tuple(own[at : at + words])].add(i)
    out = []
    for own in split:
        gone = [False] * len(own)
        for at in range(len(own) - words + 1):
            if len(seen[tuple(own[at : at + words])]) > 1:
                gone[at : at + words] = [True] * words
        out.append(gone)
    return out


def without(text, gone):
    """The text without its marked words and what is between two of them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for i, (start, stop) in enumerate(places):
        if gone[i]:
            if not (i and gone[i - 1]):
                out.append(text[at:start])
            at = stop
    return "".join([*out, text[at:]])


def passage_texts():
    """Passages about the length, in texts, across pieces, in copies, and within one text only."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join("w%d" % x for x in rng.integers(0, 3000, n))
    shared = [words(n) for n in (30, 49, 50, 51, 53, 90, 400)]
    texts = [f"{words(rng.integers(0, 80))} {shared[rng.integers(7)]}{' ' * rng.integers(0, 2)}\n{words(rng.integers(0, 80))}" for _ in range(80)]
    texts += [shared[3].replace(" ", "\n\t"), "x" + shared[4], shared[2] + " " + shared[2], words(20) + " again" * 300, "again " * 120, "a b " * 500, "b a " * 300, words(60), (words(70) + " ") * 3, "é" * 500]
    return [*texts, *texts[:3], None, "", "of few words"]


@pytest.mark.parametrize("gathered", [suffix_dedup.GATHERED, 1])
def test_passages_that_other_texts_have(spark, gathered, monkeypatch):
    texts = passage_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marks = brute_passages(texts, 50)
    got = {r["doc_id"]: r["n_repeated_words"] for r in suffix_dedup.repeated_bytes(table, gathered=gathered, words=50).collect()}
    assert got == {i: sum(m) for i, m in enumerate(marks)}
    want = {i: t if not any(m) else without(t, m) for i, (t, m) in enumerate(zip(texts, marks, strict=True))}
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.without_passages(table, gathered=gathered).collect()}
    assert left == {i: t for i, t in want.items() if not any(marks[i]) or t.split()}


def test_passages_of_given_documents(docs, odd_docs, no_docs):
    read = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = brute_passages([t for _, t in read], 50)
    got = suffix_dedup.repeated_bytes(docs, words=50).select("doc_id", "n_repeated_words")
    assert order(rows(got)) == order([(i, sum(m)) for (i, _), m in zip(read, marks, strict=True)])
    odd = suffix_dedup.without_passages(odd_docs)
    assert odd.columns == odd_docs.columns and {r["doc_id"] for r in odd.collect()} >= {0, 1, 2, 3, 4, 10, None}
    assert {r["doc_id"]: r["text"] for r in odd.where("doc_id in (6, 7, 8)").collect()} == {8: " end"}
    assert suffix_dedup.without_passages(no_docs).count() == 0


def test_texts_are_cut_once(docs):
    # a second evaluation, in the filter, would take a second Python worker for each task
    for out in (suffix_dedup.without_passages(docs), suffix_dedup.without_repeats(docs)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_words_of_pieces():
    raw = passage_texts()[0].encode() * 20
    assert (suffix_dedup.word_hashes(raw, 37) == suffix_dedup.word_hashes(raw)).all()
    assert len(suffix_dedup.word_hashes(raw)) == len(suffix_dedup.word_places(raw)[0]) == len(raw.split())


def test_runs_of_a_letter_are_few_rows():
    import pyarrow as pa

    for text, most in (("a" * 1_000_000, 30), ("ab" * 300_000, 30), ("abcdefghij" * 50_000, 30)):
        batch = pa.RecordBatch.from_pydict({"digest": [b"d" * 16], "text": [text]})
        assert sum(b.num_rows for b in suffix_dedup.anchor_rows(iter([batch]), suffix_dedup.Depth())) <= most


def test_walk_over_many_squares():
    rng = np.random.default_rng(8)
    for n, m in ((40, 70), (16, 16), (1, 33), (100, 3)):
        one, two, sizes = rng.normal(size=n), rng.normal(size=m), rng.integers(0, 5, n * m)
        order = np.argsort((one[:, None] + two[None, :]).ravel())
        order = order[sizes[order] > 0]
        for wanted in (1, 10, int(sizes.sum()) // 2, int(sizes.sum())):
            before = np.cumsum(sizes[order]) - sizes[order]
            assert multi_index.walk(one, two, sizes, wanted) == order[before < wanted].tolist()


def test_query_blocks_are_appended(spark, monkeypatch):
    rng = np.random.default_rng(21)
    table = [(i, rng.normal(size=8).tolist()) for i in range(1200)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    whole = order(rows(top_k.top_k(frame, 100))), order(rows(multi_index.nearest_neighbours(frame, 100, share=1.0)))
    for module in (top_k, multi_index):
        monkeypatch.setattr(module, "QUERIES", 5)
    assert (order(rows(top_k.top_k(frame, 100))), order(rows(multi_index.nearest_neighbours(frame, 100, share=1.0)))) == whole
    score = lambda v, w: float((v * w).sum())
    assert whole[1] == brute_nearest(table, 100, 20, score, any)


def slow_grams(text):
    """Occurrences of the hashed 1- to 3-grams, one at a time."""
    out, wrap, factors = Counter(), (1 << 32) - 1, [int(x) for x in language_id.FACTORS]
    code = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for at in range(len(code) - n + 1):
            mixed = code[at] * factors[0] & wrap
            for c in code[at + 1 : at + n]:
                mixed = (mixed ^ mixed >> 15) * factors[1] + c * factors[2] & wrap
            out[((mixed ^ mixed >> 13) * factors[1] & wrap) >> 17] += 1
    return out


def slow_model(examples, total, df, seed=42):
    """The same fit by plain loops: TF-IDF, follow-the-regularised-leader with elastic net, and the temperature."""
    from math import exp, log, sqrt

    idf = {b: log((1 + total) / (1 + n)) + 1 for b, n in df.items()}
    labels = sorted({label for label, _ in examples})
    vectors = []
    for label, grams in examples:
        v = {b: (1 + log(n)) * idf[b] for b, n in grams.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        vectors.append((labels.index(label), {b: x / norm for b, x in v.items()}))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(vectors)).tolist()
    n_back = int(len(vectors) * 0.2) if len(vectors) >= 5 else 0
    back, own = order[:n_back], order[n_back:]
    z, g2 = defaultdict(lambda: [0.0] * len(labels)), defaultdict(lambda: [0.0] * len(labels))

    def weight(b, c):
        return 0.0 if abs(z[b][c]) <= 0.02 else -(z[b][c] - (0.02 if z[b][c] > 0 else -0.02)) / ((1 + sqrt(g2[b][c])) / 1.0 + 0.1)

    def share(logits):
        top = max(logits)
        e = [exp(x - top) for x in logits]
        return [x / sum(e) for x in e]

    for _ in range(3):
        for i in rng.permutation(own).tolist():
            y, v = vectors[i]
            v = {**v, "bias": 0.1}
            w = {b: [weight(b, c) for c in range(len(labels))] for b in v}
            p = share([sum(x * w[b][c] for b, x in v.items()) for c in range(len(labels))])
            for b, x in v.items():
                for c in range(len(labels)):
                    g = x * (p[c] - (c == y))
                    z[b][c] += g - (sqrt(g2[b][c] + g * g) - sqrt(g2[b][c])) * w[b][c]
                    g2[b][c] += g * g

    def logits(v):
        return [sum(x * weight(b, c) for b, x in v.items() if b in z) + 0.1 * weight("bias", c) for c in range(len(labels))]

    checked = [(vectors[i][0], logits(vectors[i][1])) for i in back or own]
    wrong = 1 / (len(checked) + 2)
    best = None
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 200)).tolist():
        loss = 0.0
        for y, found in checked:
            p = share([x / t for x in found])
            loss -= sum(log(p[c] + 1e-300) * (1 - wrong if c == y else wrong / (len(labels) - 1)) for c in range(len(labels)))
        best = min(best, (loss, t)) if best else (loss, t)

    def predict(text):
        grams = slow_grams(text)
        v = {b: (1 + log(n)) * idf.get(b, log(1 + total) + 1) for b, n in grams.items()}
        norm = sqrt(sum(x * x for x in v.values()))
        p = share([x / best[1] for x in logits({b: x / norm for b, x in v.items()})])
        return labels[p.index(max(p))], max(p)

    return predict


def slow_languages(spark, read):
    """The slow model of rows, which have to be fewer than the sample."""
    read = [r for r in read if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] and re.search(r"[^\W\d_]", r["text"] or "")]
    grams = [slow_grams(r["text"]) for r in read]
    df = Counter(b for g in grams for b in g)
    key = {r[0]: r[1] for r in spark.createDataFrame([(r["doc_id"],) for r in read], "doc_id long").select("doc_id", F.xxhash64(F.lit(42), "doc_id")).collect()}
    packed = [(r["lang"], key[r["doc_id"]], g) for r, g in zip(read, grams, strict=True)]
    packed.sort(key=lambda x: x[:2])
    return slow_model([(lang, dict(sorted(g.items()))) for lang, _, g in packed], len(read), df)


def test_model_is_as_slow_loops_make_it(spark, docs):
    some = docs.withColumn("text", F.substring("text", 1, 160)).where("doc_id % 2 = 0")
    predict = slow_languages(spark, some.collect())
    got = {r["doc_id"]: r for r in language_id.languages(some).collect()}
    for r in some.collect():
        if re.search(r"[^\W\d_]", r["text"] or ""):
            label, score = predict(r["text"])
            assert got[r["doc_id"]]["lang_pred"] == label and abs(got[r["doc_id"]]["score"] - score) < 1e-4


def test_scores_of_no_learned_language(docs):
    model = language_id.fit(docs)
    for text in ("12 a", "xk qq zzv", "これは日本語の文章です", "Привет, как дела", "Ελληνικά γράμματα"):
        assert model.predict(text)[1] < 0.9
    right = [model.predict(r["text"])[1] for r in docs.where("lang is not null and length(text) > 200").limit(80).collect()]
    assert np.median(right) > 0.95


def test_first_rows_of_a_language_come_from_all_tasks(spark):
    table = spark.range(0, 3000, 1, 37).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"), F.xxhash64("id").alias("key"), F.col("id").alias("doc_id"))
    every = sorted((r["lang"], r["key"]) for r in table.collect())
    want = [x for lang in "ab" for x in [y for y in every if y[0] == lang][:50]]
    assert sorted((r["lang"], r["key"]) for r in language_id._first(table, 50, "key", "doc_id").collect()) == want


def test_telling_words_lose_no_licence(spark):
    """With and without the test for telling words the scan finds the same, for each known text in other spellings."""
    pieces = license_scan.telling(license_scan.KNOWN)
    assert pieces and license_scan.telling((("x", "of all"),)) is None
    back = {new: old for old, new in license_scan.SPELLINGS.items()}
    for _, text in license_scan.KNOWN:
        low = " ".join(re.findall(r"[^\W_]+", text.lower()))
        other = low
        for new, old in back.items():
            other = f" {other} ".replace(f" {new} ", f" {old} ").strip()
        assert any(p in low for p in pieces) and any(p in other for p in pieces)
    texts = [re.sub(r"\bLICENSE(S|D|E|ES)?\b", r"LICENCE\1", text.upper()) for _, text in license_scan.KNOWN] + ["nothing to see"]
    found = rows(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {i for i, _, _, whole in found if whole} == set(range(len(license_scan.KNOWN)))


def slow_mix(spark, read, shard_words=mixing.SHARD_WORDS, seed=42, cap=3, block=64):
    """For each row: its size, its source's size and target, whole rounds, and which of its words the run takes; word by word."""
    sizes = [len(WORD.findall(r["text"] or "")) for r in read]
    frame = spark.createDataFrame([(i, r["doc_id"], r["text"]) for i, r in enumerate(read)], "i long, doc_id long, text string")
    hashed = {r["i"]: (r["o"], r["s"]) for r in frame.select("i", F.xxhash64(F.lit(seed), "doc_id", "text").alias("o")).withColumn("s", F.xxhash64("o", F.lit(1))).collect()}
    named = sorted({r["source"] for r in read if r["source"] is not None}, key=lambda s: s.encode("utf-32-be")) + [None] * any(r["source"] is None for r in read)
    total = {s: sum(n for n, r in zip(sizes, read, strict=True) if r["source"] == s) for s in named}
    target, live, left = {}, {s: [1, 2, 3][i % 3] for i, s in enumerate(named)}, float(sum(sizes))
    while live:
        per = left / sum(live.values())
        over = [s for s, w in live.items() if w * per > cap * total[s]]
        for s in over or list(live):
            target[s] = float(cap * total[s]) if over else live[s] * per
            left -= target[s] if over else 0
            del live[s]

    def seats(votes, n, most):
        given = [0] * len(votes)
        for _ in range(n):
            free = [i for i in range(len(votes)) if given[i] < most[i] and votes[i] > 0]
            if not free:
                break
            given[max(free, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))] += 1
        return given

    quota = dict(zip(named, seats([target[s] for s in named], sum(sizes) // block, [cap * total[s] // block for s in named]), strict=True))
    out = [None] * len(read)
    for s in named:
        rows_of = [i for i, r in enumerate(read) if r["source"] == s]
        shards = defaultdict(list)
        count = max(1, -(-total[s] // shard_words))
        for i in rows_of:
            shards[hashed[i][1] % count].append(i)
        order_ = sorted(shards)
        lengths = [sum(sizes[i] for i in shards[k]) for k in order_]
        dealt = seats(lengths, quota[s], [cap * x // block for x in lengths])
        short = int(round(target[s])) - sum(dealt) * block
        start = {r["k"]: r["h"] for r in spark.createDataFrame([(s, k) for k in order_], "source string, k long").select("k", F.xxhash64(F.lit(seed), "source", "k").alias("h")).collect()}
        for k, length, n in zip(order_, lengths, dealt, strict=True):
            more = max(min(short, cap * length - n * block), -n * block)
            short -= more
            words = n * block + more
            own = sorted(shards[k], key=lambda i: (hashed[i][0], read[i]["doc_id"], sizes[i]))
            stream = [(i, w) for i in own for w in range(sizes[i])]
            rounds, rest = divmod(words, max(1, length))
            at = start[k] % max(1, -(-max(1, length) // block)) * block
            run = {stream[(at + j) % length] for j in range(rest)} if length else set()
            for i in own:
                out[i] = (sizes[i], total[s], target[s], rounds if sizes[i] else 0, [(i, w) in run for w in range(sizes[i])])
    return out


def mixed_texts(read, mixed):
    out = []
    for r, (size, _, _, rounds, run) in zip(read, mixed, strict=True):
        out += [(r, r["text"])] * rounds
        if any(run):
            out.append((r, r["text"] if all(run) else " ".join(w for w, taken in zip(WORD.findall(r["text"]), run, strict=True) if taken)))
    return out


@pytest.mark.parametrize("shard_words", [mixing.SHARD_WORDS, 9_000])
def test_mix_word_by_word(spark, docs, shard_words):
    read = docs.collect()
    mixed = slow_mix(spark, read, shard_words)
    want = order([(r["doc_id"], size, total, target, rounds * size + sum(run)) for r, (size, total, target, rounds, run) in zip(read, mixed, strict=True)])
    assert order(rows(mixing.mix(docs, shard_words=shard_words))) == want
    got = mixing.mixed_documents(docs, shard_words=shard_words).select("doc_id", "text")
    assert order(rows(got)) == order([(r["doc_id"], text) for r, text in mixed_texts(read, mixed)])


def slow_pipeline(spark, read):
    """The stages one after the other by plain loops: rows (doc_id, ids, bytes)."""
    import tiktoken

    predict = slow_languages(spark, read)
    told = [r for r in read if re.search(r"[^\W\d_]", r["text"] or "") and predict(r["text"])[1] >= 0.5]
    group = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in told])
    kept = [dict(r.asDict()) for r, (d, _, c) in zip(told, group, strict=True) if d == c]
    marks = brute_passages([r["text"] for r in kept], 50)
    for r, gone in zip(kept, marks, strict=True):
        r["text"] = without(r["text"], gone) if any(gone) else r["text"]
    kept = [r for r in kept if WORD.search(r["text"])]
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [(r["doc_id"], library.encode_ordinary(text), text) for r, text in mixed_texts(kept, slow_mix(spark, kept))]


def test_pipeline_is_its_slow_stages(spark, data, docs):
    import corpus_pipeline

    want = [(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids) for d, ids, text in slow_pipeline(spark, docs.collect())]
    got = corpus_pipeline.run(spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    assert want and order(rows(got)) == order(want)


def test_pipeline_of_an_empty_table(spark, no_docs, tmp_path):
    import corpus_pipeline

    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_words_one_by_one(tmp_path):
    """The heap gives what looking at every pair each time gives, also for long words, and in a time that grows with their length."""
    import base64
    import time

    tokens = [bytes([b]) for b in range(256)] + [b"abcd", b"cd", b"ab", b"bcd", b"xab", b"aa", b"aaaa", b"aaa"]
    path = tmp_path / "r.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    codec = byte_bpe.Codec(str(path), public_tokenizers.PATTERN)

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((codec.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [codec.ranks[p] for p in parts]

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 40, 300):
        for _ in range(20):
            word = bytes(rng.choice(list(b"abcdx"), n).tolist())
            assert codec.one(word) == plain(word)
    began = time.perf_counter()
    assert len(codec.one(b"a" * 400_000)) == 100_000
    assert time.perf_counter() - began < 60


def test_one_very_long_url(spark):
    table = spark.createDataFrame([(1, "x://example.com/de/" + "a/" * 100_000), (2, "x://net/login")], "page_id long, url string")
    assert [tuple(r)[1:] for r in url_filter.judge(table, queries.RULES, queries.GLOBS).orderBy("page_id").select("page_id", "rule", "verdict").collect()] == [("example.com/de/", "block"), ("net/", "block")]


def test_clashing_names_and_long_texts_of_tokens(spark, monkeypatch):
    """Columns named like the results are replaced, others kept; texts of several pieces give the ids of whole ones."""
    from terraql.llm import split

    rng = np.random.default_rng(15)
    long = " ".join("".join(rng.choice(list("abcdeé日"), rng.integers(1, 9))) for _ in range(3000))
    table = spark.createDataFrame([(1, long, 5, "r", "x"), (2, None, 6, "s", "y")], "doc_id long, text string, n_tokens long, row string, Made string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.round_trip(table, path, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [r["row"] for r in got] == ["r", "s"] and [r["Made"] for r in got] == ["x", "y"] and got[1]["n_tokens"] == 0
    codec = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    whole = codec.encode([long])
    assert got[0]["n_tokens"] == len(whole[0]) // 4
    for name, value in (("HELD", 50), ("NEW", 10), ("REMEMBERED", 20), ("AT_ONCE", 7)):
        monkeypatch.setattr(byte_bpe, name, value)
    monkeypatch.setattr(split, "PIECE", 64)
    assert byte_bpe.Codec(path, public_tokenizers.PATTERN).encode([long]) == whole
    counted = token_counts.token_counts(table, public_tokenizers.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r["row"] for r in counted] == ["r", "s"] and counted[1]["n_tokens"] == 0 and counted[0]["n_tokens"] > 3000


def test_fingerprints_of_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)
