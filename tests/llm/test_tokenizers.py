"""Round trips and the libraries' own ids."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import content_store, piece_dropout
from barograph.llm.tokens import Encoder

tables = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "a", "plain words, here.", "two  spaces", " lead", "trail ", "x\n\ny \n z", "tab\tand\u00a0nbsp", "日本語 😀 ▁ lit ▁▁", "a▁b", "don't!!! 'll <|endoftext|> x", "word. word, word.", "A" * 3000, "é " * 900]


def tables_without(spark, path, lost):
    from barograph.sources.tables import write_shared

    return write_shared(spark.read.parquet(path).where(f"not ({lost})"), "damaged")


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    path = tables.path("byte_bpe_50k.json")
    own, library = Encoder(path, 0), Tokenizer.from_file(path)
    for _ in range(2):  # the second time from what it keeps
        for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_encoder_keeps_words_not_what_lines_and_marks_join():
    own = Encoder(tables.path("byte_bpe_50k.json"), 0)
    own.encode(["one two.\nThree two, two!!", "one two\nThree<|endoftext|>"])
    assert own.known.keys() == {"one", " two", ".", ",", "!!", "\n", "Three", "Three<|endoftext|>"}


def test_any_white_space_marks_and_added_tokens_give_the_library_s_ids():
    import random

    from tokenizers import Tokenizer

    path, rng = tables.path("byte_bpe_50k.json"), random.Random(5)
    own, library = Encoder(path, 0), Tokenizer.from_file(path)
    parts = [*" \n\t\r\x1c\x85\xa0\u1680\u2000\u2009\u2028\u202f\u205f\u3000\u200b\u3001\u2014\u00bf\u65e5\u00e9a1.,!'\"*<|>_\0", " ", " ", "\n\n", "bc", "don't", "Word.", " word", "<|endoftext|>", "\U0001f600"]
    for _ in range(100):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(40))]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_store_gives_back_all_ids(spark):
    from tokenizers import Tokenizer

    path = tables.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*TEXTS, None, TEXTS[-1], TEXTS[-1]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    store = content_store.write(table, path)
    got = {r["doc_id"]: r for r in content_store.read_back(spark, store).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: r["ids"][-1] for r in content_store.documents_of(spark, store).collect()} == dict.fromkeys(range(len(texts)), 0)
    digests = spark.read.parquet(store.chunks).select("digest")
    assert digests.count() == digests.distinct().count()
    for damaged, message in ((store._replace(chunks=tables_without(spark, store.chunks, "n > 100")), "chunk is missing"), (store._replace(recipes=tables_without(spark, store.recipes, "doc_id = 3")), "manifest")):
        with pytest.raises(Exception, match=message):
            content_store.read_back(spark, damaged).collect()
    none = content_store.write(table.where("false"), path)
    assert content_store.read_back(spark, none).count() == 0


def test_without_dropout_the_ids_are_sentencepiece_s():
    import sentencepiece

    path = tables.path("piece_bpe_32k.model")
    own, library = piece_dropout.Pieces(path, 0.0, 1), sentencepiece.SentencePieceProcessor(model_file=path)
    for text, ids in zip(TEXTS, own.encode(TEXTS, list(range(len(TEXTS)))), strict=True):
        if "▁" not in text:
            assert np.frombuffer(ids, own.dtype).tolist() == library.encode(text)
        assert own.decode(ids) == text


def test_dropout_varies_by_seed_and_decodes(spark):
    path = tables.path("piece_bpe_32k.model")
    table = spark.createDataFrame([*enumerate(TEXTS), (None, "words and words and words"), (99, None)], "doc_id long, text string")
    one, two = (piece_dropout.encode(table, path, 0.3, seed).collect() for seed in (1, 2))
    assert all(r["lossless"] for r in one + two)
    assert [r["ids"] for r in one] != [r["ids"] for r in two]
    assert sum(r["n_tokens"] for r in one) > sum(r["n_tokens"] for r in piece_dropout.encode(table, path, 0.0, 1).collect())
    again = piece_dropout.encode(table.repartition(5), path, 0.3, 1)
    assert {(r["doc_id"], bytes(r["ids"])) for r in one} == {(r["doc_id"], bytes(r["ids"])) for r in again.collect()}
    back = piece_dropout.decode(again, path, 0.3, 1)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in table.collect()}
    assert piece_dropout.encode(table.where("false"), path).count() == 0


def test_every_occurrence_draws_its_own_skips():
    path = tables.path("piece_bpe_32k.model")
    own = piece_dropout.Pieces(path, 0.1, 1)
    texts = ["words " * 3000 + "elsewhere", "words " * 3000, "x" * 200 + " words"]
    first = own.encode(texts, [7, 8, 9])
    assert own.encode(texts, [7, 8, 9]) == first  # from the trees
    direct = piece_dropout.Pieces(path, 0.1, 1)
    direct.roots = type("Nothing", (dict,), {"get": lambda self, key, other: other})()  # no tree is ever found
    assert direct.encode(texts, [7, 8, 9]) == first
    names = [own.text[i] for i in np.frombuffer(first[0], own.dtype)]
    cuts = [tuple(w.split(b"|")) for w in b"|".join(names).replace(b"| ", b"\n ").split(b"\n")]
    seen = {c for c in cuts if b"".join(c) == b" words"}
    assert len(seen) > 4
    assert 0.02 < np.mean([len(c) > 1 for c in cuts]) < 0.6
    assert [own.decode(i) for i in first] == texts


def test_ids_do_not_depend_on_what_shares_a_batch(spark):
    path = tables.path("piece_bpe_32k.model")
    table = spark.createDataFrame([*enumerate(TEXTS * 3)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "lossless")})
    all_at_once = {r["doc_id"]: bytes(r["ids"]) for r in piece_dropout.encode(table.repartition(1), path, 0.3, 1).collect()}
    for i in (0, 2, 7, 14):
        alone = piece_dropout.encode(table.where(F.col("doc_id") == i), path, 0.3, 1).first()
        assert bytes(alone["ids"]) == all_at_once[i]


def slow_ids(own, text, doc_id, seed, dropout):
    """The agenda of each chunk, one merge at a time, from the vocabulary's pieces."""
    mask, gold = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x &= mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return x ^ (x >> 31)

    merges = {divmod(int(k), own.n): int(i) for k, i in zip(own.pair_keys, own.pair_ids, strict=True)}
    of_doc = mix(piece_dropout._key(doc_id) ^ mix(seed + gold))
    out = []
    for place, chunk in enumerate(piece_dropout._RUNS.findall(f" {text}") if text else []):
        key = mix(of_doc + (place + 1) * gold)
        symbols = [int(own.char[ord(c)]) if own.char[ord(c)] >= 0 else -2 - ord(c) for c in chunk]
        skipped, step = set(), 0
        while True:
            step += 1
            pairs = [(-float(own.score[merges[p]]), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges and i not in skipped]
            if not pairs:
                break
            _, i = min(pairs)
            piece = merges[symbols[i], symbols[i + 1]]
            if (mix(key ^ mix(piece + step * gold)) >> 11) * 2.0**-53 < dropout:
                skipped.add(i)
                continue
            symbols[i : i + 2] = [piece]
            skipped = set()
        for s in symbols:
            out += [int(own.bytes[b]) for b in chr(-2 - s).encode()] if s < 0 else [s]
    return out


def test_ids_are_those_of_a_slow_agenda():
    path = tables.path("piece_bpe_32k.model")
    texts = [t for t in TEXTS if len(t) < 500] + ["the quick brown foxes were running unbelievably internationalization " * 5]
    for dropout in (0.0, 0.1, 0.5):
        own = piece_dropout.Pieces(path, dropout, 3)
        got = own.encode(texts, [piece_dropout._key(i) for i in range(len(texts))])
        for i, t in enumerate(texts):
            assert np.frombuffer(got[i], own.dtype).tolist() == slow_ids(own, t, i, 3, dropout)


def test_long_chunks_have_the_same_ids_and_end_in_time(monkeypatch):
    import random
    import time

    path, rng = tables.path("piece_bpe_32k.model"), random.Random(3)
    texts = ["".join(rng.choice("abcdefghij中文é€ ▁"[:n]) for _ in range(k)) for n, k in ((10, 60), (10, 700), (16, 900), (14, 300), (1, 200), (3, 40))]
    for dropout in (0.0, 0.1, 0.4):
        want = piece_dropout.Pieces(path, dropout, 1).encode(texts, list(range(6)))
        with monkeypatch.context() as m:
            m.setattr(piece_dropout, "LONG", 10)
            assert piece_dropout.Pieces(path, dropout, 1).encode(texts, list(range(6))) == want
    own, text = piece_dropout.Pieces(path, 0.1, 1), "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000))
    begin = time.time()
    [ids] = own.encode([text], [5])
    assert own.decode(ids) == text and time.time() - begin < 60
