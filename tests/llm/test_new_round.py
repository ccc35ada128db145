"""Language-model scoring, lexical search and the Merkle manifest, against their SQL and on odd rows."""

import collections
import hashlib
import math
import os
import re
import statistics
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.llm import chat, katz, kernels, lexical_search, merkle_manifest, pieces, queries

RNG = np.random.default_rng(11)
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def tables(tmp_path, spark, documents, benchmark=()):
    spark.createDataFrame(documents, FULL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


def same_as_sql(spark, folder, con, name):
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def prose(n, words=60):
    return " ".join(f"W{i}" for i in RNG.integers(0, words, n))


def odd_documents():
    out = [(i, prose(12), "de", "s", 3) for i in range(600)]  # over one block of 512 leaves
    out += [(i, prose(9), ["en", None, "ä", "z"][i % 4], None, None) for i in range(600, 640)]
    out += [(7, "x", "de", "s", 1), (7, "x", "de", "s", 1), (7, "y", "de", None, 1), (None, None, None, None, None), (None, "Null id", "fr", "s", 9), (-3, "", "one", "s", 0), (8, "A" * 70_000, "fr", "s", 70_000)]
    return out


def test_manifest_is_sql_s_on_odd_rows(spark, tmp_path):
    folder, con = tables(tmp_path, spark, odd_documents())
    got = same_as_sql(spark, folder, con, "op13_merkle_manifest")
    assert len(got) == len(odd_documents()) and got["root"].nunique() == 1
    assert 0 < got["verified"].sum() < len(got)
    assert (got["verified"] == (got["folded_root"] == got["root"])).all()


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "T", "en", "s", 1)], FULL)
    [r] = merkle_manifest.verify(one, F.col("text")).collect()
    leaf = hashlib.sha256(b"1:11:s2:en1:11:T").hexdigest()
    assert (r["leaf"], r["subroot"], r["root"], r["folded_root"], r["verified"]) == (leaf, leaf, leaf, leaf, True)
    assert r["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle_manifest.verify(one.limit(0), F.col("text")).count() == 0


def test_manifest_ignores_layout_and_other_columns(spark):
    docs = spark.createDataFrame(odd_documents(), FULL)
    wanted = {tuple(r) for r in merkle_manifest.verify(docs.repartition(2), F.col("text")).collect()}
    more = docs.withColumns({c: F.lit("clash") for c in ("grp", "n", "at", "digest", "carried", "block", "position", "l0")}).repartition(7)
    assert {tuple(r) for r in merkle_manifest.verify(more, F.col("text")).collect()} == wanted


def test_manifest_stores_every_third_level(spark):
    manifest = merkle_manifest.build(spark.createDataFrame(odd_documents(), FULL))
    assert len(manifest.lower) == 2 and len(manifest.upper) == 1
    upper = spark.read.parquet(manifest.lower[1]).where("grp = 'de'").collect()
    assert [r["n"] for r in upper] == [2] and len(upper[0]["nodes"]) == 2  # 603 leaves: two subtrees of 512


def test_search_is_sql_s_on_odd_rows(spark, tmp_path):
    documents = odd_documents() + [(900 + i, prose(int(n), 40 + 30 * (i % 9)), "en", "s", 1) for i, n in enumerate(RNG.integers(1, 400, 150))]
    documents += [(2000 + i, "w5 w6 w7 rare", "en", "s", 1) for i in range(45)]  # more ties than ranks
    documents += [(2100, "W1 " * 700 + "é-W2_w3", "en", "s", 1)]
    items = [(i, prose(30, 200)) for i in range(25)] + [(30, None), (31, " . "), (None, "w5 w6 w7"), (32, "w5 W5 w5 rare"), (32, "rare"), (33, "nowhere at all")]
    folder, con = tables(tmp_path, spark, documents, items)
    got = same_as_sql(spark, folder, con, "op12_hashed_max_sketches")
    assert set(got["item_id"].dropna()) == {*range(25), 32} and got["item_id"].isna().sum() == 20
    same_as_sql_again = lexical_search.search(spark.read.parquet(f"{folder}/documents.parquet").repartition(9), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert rows(same_as_sql_again.toPandas()) == rows(got)


def test_search_in_several_blocks_and_of_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(40)) for i in range(200)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "terms", "query", "item_id", "rank", "score")})
    items = spark.createDataFrame([(i, prose(10)) for i in range(12)], "item_id long, text string").withColumns({c: F.lit("clash") for c in ("query", "terms", "doc_id", "n_terms")})
    once = {tuple(r) for r in lexical_search.search(docs, items).collect()}
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    assert {tuple(r) for r in lexical_search.search(docs, items).collect()} == once and len(once) == 240
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0


def test_bounds_never_lie_below_scores():
    for n in (1, 5, 300, 5000):
        terms = np.unique(kernels.mix(RNG.integers(1, 10_000, n).astype(np.uint64)))
        tfs = RNG.integers(1, 400, len(terms)).astype(np.uint32)
        query = np.unique(np.append(terms[:20], kernels.mix(RNG.integers(20_000, 30_000, 40).astype(np.uint64))))
        block = lexical_search.Block([0], np.array([0, len(query)]), query, RNG.integers(0, 9000, len(query)))
        upper = lexical_search.bounds(block, lexical_search.sketch(terms, tfs)[None, :], np.array([130]))[0, 0]
        assert upper >= lexical_search.exact(block, 0, terms, tfs, 130) > 0


def test_long_texts_come_in_pieces():
    data = np.frombuffer(("ab " * 1000 + "c" * 5000 + " d").encode(), np.uint8)
    cuts = list(pieces.cut(data, 100))
    assert b"".join(c.tobytes() for c in cuts) == data.tobytes() and max(map(len, cuts)) == 5001
    assert len(list(pieces.cut(np.frombuffer(b"x" * 1000, np.uint8), 100))) == 1


def by_hand_discounts(counts):
    n, k = collections.Counter(counts), 5
    if all(n[r] for r in range(1, k + 2)):
        common = (k + 1) * n[k + 1] / n[1]
        out = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common != 1 else 9 for r in range(1, k + 1)]
        if common < 1 and all(0 < d < 1 for d in out):
            return out
    known = [r for r in range(1, k + 2) if n[r]]
    if len(known) > 1:
        slope = statistics.linear_regression([math.log(r) for r in known], [math.log(n[r]) for r in known]).slope
        if slope < -1:
            common = (k + 1) ** (1 + slope)
            return [(((r + 1) / r) ** (1 + slope) - common) / (1 - common) for r in range(1, k + 1)]
    lost = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [(r - lost) / r for r in range(1, k + 1)]


class ByHand:
    """The same model from dictionaries of strings."""

    def __init__(self, texts):
        self.u, self.b = collections.Counter(), collections.Counter()
        for text in texts:
            tokens = self.tokens(text)
            self.u.update(tokens)
            self.b.update(zip([None, *tokens], tokens))
        self.n = sum(self.u.values())
        self.d1, self.d2 = by_hand_discounts(self.u.values()), by_hand_discounts(self.b.values())
        lost = sum(c - self.kept(self.d1, c) for c in self.u.values())
        self.all = self.n + (lost <= 0)
        self.unknown = (lost + (lost <= 0)) / self.all if self.all else 1.0
        self.contexts = {}
        after = collections.defaultdict(list)
        for (h, w), c in self.b.items():
            after[h].append((w, c))
        for h, seen in after.items():
            left = sum(c - self.kept(self.d2, c) for _, c in seen)
            more = left <= 1e-12
            total = sum(c for _, c in seen) + more
            self.contexts[h] = total, (left + more) / total / (1 - sum(self.p(w) for w, _ in seen))

    @staticmethod
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), " "]

    @staticmethod
    def kept(d, c):
        return d[c - 1] * c if c <= 5 else c

    def p(self, w, h=False):
        if h is not False and (h, w) in self.b:
            return self.kept(self.d2, self.b[h, w]) / self.contexts[h][0]
        own = self.kept(self.d1, self.u[w]) / self.all if self.u[w] else self.unknown
        return own if h is False else own * self.contexts.get(h, (0, 1.0))[1]

    def row(self, text):
        tokens = self.tokens(text)
        base = sum(math.log10((self.u[w] + 1) / (self.n + len(self.u) + 1)) for w in tokens)
        return len(tokens), sum(w in self.u for w in tokens), self.n, base, sum(math.log10(self.p(w, h)) for h, w in zip([None, *tokens], tokens))


def katz_documents():
    out = [(i, prose(int(n), 12 + 3 * (i % 40)), "en", "s", 1) for i, n in enumerate(RNG.integers(0, 120, 160))]
    out += [(300 + i, "The same copy. of SOME  text\n\there", "en", "s", 1) for i in range(20)]
    out += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, " \t\n", "en", "s", 3), (403, "the " * 900, "en", "s", 1), (None, "null id é Ä\u00a0nbsp", "en", "s", 1)]
    return out + [(5, "twice the row", "en", "s", 1)] * 3 + [(9, "never seen words", "en", "s", 1)]


def check_katz(got, documents):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = ByHand([d[1] for d in documents if not held(d[0])])
    want = sorted([(d[0], held(d[0]), *model.row(d[1])) for d in documents], key=repr)
    have = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=repr)
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6])), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


@pytest.mark.parametrize("share", [1 << 16, 8])  # few words are hot with the second
def test_katz_is_the_dictionaries_model(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    documents = katz_documents()
    folder, _ = tables(tmp_path, spark, documents)
    model = check_katz(queries.QUERIES["op11_katz_backoff"](spark, folder).collect(), documents)
    for h in (None, "the", "w1", "unseen"):
        assert sum(model.p(w, h) for w in model.u) + model.unknown * model.contexts.get(h, (0, 1.0))[1] == pytest.approx(1)


def test_katz_of_long_texts_in_pieces_and_of_clashing_columns(spark, monkeypatch):

    docs = [(i, prose(200, 50)) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("bucket", "kind", "id", "a", "word", "n", "score")})
    want = sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in katz.score(frame, katz.train(frame)).collect())
    batch = frame.select("doc_id", "text").coalesce(1).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(katz, "SLICE", 64)
    many = list(katz.token_slices(batch))
    monkeypatch.setattr(katz, "SLICE", 1 << 21)
    [one] = list(katz.token_slices(batch))
    assert len(many) > 100 and sum(s.last for s in many) == 12
    assert np.array_equal(np.concatenate([s.tokens for s in many]), one.tokens) and np.array_equal(np.concatenate([s.contexts for s in many]), one.contexts)
    model = ByHand([t for _, t in docs])
    assert want == sorted((i, *model.row(t)[:2], round(model.row(t)[4], 6)) for i, t in docs)


def test_katz_with_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = katz.score(docs, katz.train(docs.limit(0))).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows) == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert katz.score(docs.limit(0), katz.train(docs)).count() == 0


def test_chats_are_read_back_in_any_order(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"<s> {c} {t} [INST]") for c in range(20) for t in range(2 + c % 3)] + [(None, 0, None, None)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(chat.text_parts(turns))
    want = {tuple(r) for r in chat.digests(formatted).collect()}
    assert len(want) == 21
    formatted.repartition(5).write.parquet(f"{tmp_path}/chats")
    again = spark.read.parquet(f"{tmp_path}/chats")
    assert {tuple(r) for r in chat.digests(again).collect()} == {tuple(r) for r in chat.digests(formatted.coalesce(1)).collect()} == want
    for broken in (again.where("NOT (conv_id = 3 AND seq = 0)"), again.unionByName(again.where("conv_id = 4 AND seq = 1"))):
        with pytest.raises(Exception, match="lacks a turn"):
            chat.digests(broken).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_hashed_max_sketches", "op13_merkle_manifest"])
def test_rows_are_those_of_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    same_as_sql(spark, folder, con, name)
