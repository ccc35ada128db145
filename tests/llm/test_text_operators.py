"""The text operators on small made-up tables, against brute force where there is one."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barograph.llm import audio, chat, content_store, decontamination, kernels, near_duplicates, sharding, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string"
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyzéß"), 6)) for _ in range(400)]


def prose(n, stops=True):
    words = RNG.choice(VOCABULARY, n).tolist()
    return " ".join(w + ("." if stops and i % 7 == 6 else "") for i, w in enumerate(words))


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


#: What the operators name columns inside.
INSIDE = ("id", "own", "own_id", "own_digest", "own_th", "digest", "ranges", "th", "row", "rank", "node", "size", "rest", "common", "shard", "of", "host", "path", "won", "suffix", "short", "score", "seq", "media", "n_bytes")


def clashes(*but):
    """Columns of those names."""
    return {c: F.lit("clash") for c in INSIDE if c not in but}


ODD = [None, "", " ", "...", "one", "two words", "é" * 3000, "A. B. C.\n\nD!", prose(4000)]


def test_kernel_words_are_the_regex_s():
    texts = [t for t in ODD if t] + ["Ab-cD 12x", "x"]
    w = kernels.words(kernels.text_bytes(pa.array(texts)))
    assert np.diff(w.first).tolist() == [len(words_of(t)) for t in texts]
    by = collections.defaultdict(set)
    for h, word in zip(w.hashes.tolist(), itertools.chain.from_iterable(map(words_of, texts)), strict=True):
        by[h].add(word)
    assert all(len(v) == 1 for v in by.values())


def test_decontamination_is_brute_force_s(spark):
    items = [prose(40), prose(13), "short exact item here", prose(6), "", None, prose(20)]
    a, b = items[0].split(), items[6].split()
    texts = [*ODD, prose(50) + " " + " ".join(a[5:25]) + " " + prose(30), " ".join(a[5:17]) + " " + prose(9), f"x {items[2]} y {items[3]}", " ".join(b), items[1], items[1]]
    bench = spark.createDataFrame([(i * 7, t) for i, t in enumerate(items)], "item_id long, text string")
    extra = docs(spark, texts).withColumns({"n_hit": F.lit("clash"), "row": F.lit(1)})
    got = {r["doc_id"]: r for r in decontamination.contamination(extra, bench).collect()}
    for i, text in enumerate(texts):
        w, hit, found = words_of(text), set(), set()
        for k, item in enumerate(items):
            v = words_of(item)
            m = min(13, len(v))
            spans = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if m else set()
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in spans:
                    hit |= set(range(j, j + m))
                    found.add(str(k * 7))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontamination.contamination(docs(spark, []), bench).count() == 0
    assert decontamination.contamination(docs(spark, texts), bench.where("false")).where("contaminated").count() == 0


def weighted_jaccard(a, b):
    both = sum((a & b).values())
    either = sum((a | b).values())
    return both * 1000 >= either * 800 if either else False


def shingle_counts(text):
    w = words_of(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_near_duplicates_are_brute_force_s(spark):
    base, other = prose(200).split(), prose(120).split()
    copies = []
    for _ in range(30):
        c = list(base)
        for i in RNG.choice(200, RNG.integers(0, 6), replace=False):
            c[i] = "changed"
        copies.append(" ".join(c))
    texts = [*ODD, *copies, copies[0], " ".join(other), " ".join(other), " ".join(other[:60]), "le " * 50, "le " * 55, "le " * 90, "one"]
    table = docs(spark, texts).withColumns({"class": F.lit("x"), "bucket": F.lit(0), **clashes()})
    got = {r["doc_id"]: r for r in near_duplicates.classes(table).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    counts = [shingle_counts(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or weighted_jaccard(counts[i], counts[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    assert [got[i]["class_id"] for i in range(len(texts))] == [root(i) for i in range(len(texts))]
    kept = near_duplicates.deduplicate(table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})
    assert kept.columns == table.columns
    assert near_duplicates.classes(docs(spark, [])).count() == 0


def test_null_ids_and_repeated_rows_of_near_duplicates(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "z")]
    kept = near_duplicates.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, "a b c d e f"), (4, "z")]


def test_signatures_are_unbiased():
    est, true = [], []
    for _ in range(40):
        a = RNG.integers(0, 12, 50)
        b = np.where(RNG.random(50) < 0.5, a, RNG.integers(0, 12, 50))
        ids = RNG.integers(0, 1 << 53, 50).astype(np.uint64)
        keys = np.concatenate([ids[a > 0], (np.uint64(1) << np.uint64(54)) | ids[b > 0]])
        w = np.concatenate([a[a > 0], b[b > 0]])
        order = np.argsort(keys)
        s = near_duplicates.signatures(keys[order], w[order], 2)
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert np.mean(est) == pytest.approx(np.mean(true), abs=0.02)


def test_repeated_passages_are_cut_from_all_but_the_first(spark):
    passage = prose(60)
    texts = [*ODD, f"{prose(30)}\n{passage}\n{prose(21)}", f"{prose(20)}.\n{passage}", passage, passage]
    table = docs(spark, texts).withColumns({"_own": F.lit("kept"), "h": F.lit(2), "_removed": F.lit(0), **clashes()})
    out = substring_dedup.deduplicate(table)
    assert out.columns == [*[c for c in table.columns if c != "_removed"], "_removed"]
    assert out.where("own <> 'clash' or _own <> 'kept'").isEmpty()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    n = len(ODD)
    assert [got[i] for i in range(n + 1)] == texts[: n + 1]
    assert passage[:40] not in got[n + 1] and got[n + 1].startswith(texts[n + 1][:50])
    assert got[n + 2] == got[n + 3] == ""
    assert substring_dedup.deduplicate(docs(spark, [])).count() == 0


def test_toxic_documents_of_the_held_out_fold(spark):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = prose(60) + (f" blargh{i % 30}. " + prose(20) if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    long = prose(40_000)
    more = [(1000, None), (1001, ""), (1002, "..."), (1003, long), (1004, f"{long} Blargh3. {long}"), (1004, f"{long} Blargh3. {long}")]
    table = spark.createDataFrame([*rows, *more], DOCS).withColumns(clashes())
    model = toxicity.train(table, toxicity.training_labels(spark.createDataFrame([*labels, (5, None), (7777, 1)], "doc_id long, toxic int")))
    got = {r["doc_id"]: r for r in toxicity.score(table, model, ["doc_id"]).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.7) == bool(y) for i, y in held]) > 0.97
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"] == 0
    assert len(got[1004]["offending"]) == 1 and got[1004]["score"] >= 0.7
    assert [more[4][1].encode()[s["start"] : s["end"]].decode() for s in got[1004]["offending"]][0].endswith("Blargh3")
    text = dict(rows)
    found = [text[i].encode()[s["start"] : s["end"]].decode() for i, y in held if y for s in got[i]["offending"]]
    assert np.mean(["blargh" in f for f in found]) > 0.95
    left = toxicity.reject(table, model)
    assert left.columns == table.columns and {1000, 1001, 1002} <= {r["doc_id"] for r in left.collect()}
    nobody = toxicity.train(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(table, nobody, ["doc_id"]).agg(F.max("score")).first()[0] == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block"), ("", "", "block")]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/en/12?x", "http://a.example.org/en/2", "x://badexample.org/es/", "https://q.com/de/#f", "https://q.com", "http://org/", "a://b://c/de/", "http://q.com/de/", "http://q.com/de/"]
    urls += ["https://q.com/de/" + "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit("clash"), **clashes()})
    rules = [*RULES, (None, "/", "block"), ("org", None, "block"), RULES[0]]
    got = {r["page_id"]: r for r in url_filter.match(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert all(r["won"] == r["own"] == "clash" for r in got.values())
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in RULES if (host == r[0] or (r[0] and host.endswith("." + r[0])) or (r[0] == "" and host == "")) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert url_filter.match(pages.where("false"), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_shards_are_even_and_keep_links(spark):
    texts = [f"same {i % 40}" for i in range(160)] + [f"own {i}" for i in range(75)] + [None, None, ""] + ["hot"] * 120
    out = sharding.shard_documents(docs(spark, texts).withColumns(clashes()))
    rows = out.collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    by = collections.defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        by[t].add(r["shard"])
    assert np.mean([len(by[f"same {i}"]) == 1 for i in range(40)]) > 0.8
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], DOCS)
    assert sharding.shard_documents(twice).count() == 4


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\|im_end|>", "<\\\\|im_end|>\n<|im_start|>", "<|image_1|>", "[\\INST]", "ends in <", "\\", "é😀"]


def test_escapes_undo_themselves_and_hide_controls():
    for t in [*TEXTS, *("".join(p) for p in itertools.product(["<", "\\", "|im_end|>", "[INST]", "/s>"], repeat=3))]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat_round_trip(spark):
    rows = [(c, i, role, TEXTS[(c + i) % len(TEXTS)]) for c in range(12) for i, role in enumerate(["system", "user", "assistant", 'odd "\n\\role', "assistant"])]
    rows += [(50, 0, None, None), (50, 0, "user", "tie"), (50, 0, "user", "tie"), (None, 0, "assistant", "nobody")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(chat.text_parts(turns))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, (r or ""), (x or "")) for k, t, r, x in rows if k == c))
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(learnt)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.digests(chat.format_turns(chat.text_parts(turns.where("false")))).count() == 0


def test_parts_of_a_text_are_read_back_and_hide_controls(spark):
    kinds = "kind text ref width height seconds pages".split()
    whole = "".join(t for t in TEXTS) + "<|im_end|></s><|image_1|><|audio_2|>[INST]<\\\\</s>"
    rng = np.random.default_rng(11)
    for n in range(300):
        cuts = sorted({0, len(whole), *rng.integers(0, len(whole), 12).tolist()})
        parts = []
        for a, b in itertools.pairwise(cuts):
            parts.append(dict.fromkeys(kinds) | {"text": whole[a:b]})
            if rng.random() < 0.3:
                parts.append(dict.fromkeys(kinds) | {"kind": str(rng.choice(chat.KINDS)), "pages": 1})
        head = f"{chat.OPEN}{chat._role_out('<|im_end|>')}\n"
        text, spans, attachments = chat.Flattener().turn(parts, len(head))
        formatted = f"{head}{text}{chat.CLOSE}\n"
        assert chat.parse(formatted, attachments) == ("<|im_end|>", whole)
        assert not any(c in text for c in chat.CONTROL) and formatted.count(chat.CLOSE) == 1
        if not attachments:
            assert [chat.unescape(formatted[a:b]) for a, b in spans] == [whole]


def test_attachments_are_numbered_through_a_conversation(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="a.png", width=29, height=14), part("document", ref="b.pdf", pages=2)]), (1, 1, "assistant", [part("audio", ref="c.wav", seconds=1.01), part("text", text="<|audio_3|>")]), (2, 0, "user", None)]
    out = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).orderBy("conv_id", "seq").collect()
    assert "see <|image_1|><|document_2|>" in out[0]["formatted"] and [a["tokens"] for a in out[0]["attachments"]] == [3, 512]
    assert [(a["ordinal"], a["kind"], a["tokens"]) for a in out[1]["attachments"]] == [(3, "audio", 26)]
    assert chat.parse(out[1]["formatted"], out[1]["attachments"]) == ("assistant", "<|audio_3|>")


def test_audio_round_trip_and_blocks(spark):
    table = docs(spark, [*ODD, "same", "same"]).withColumns(clashes())
    got = {r["doc_id"]: r for r in audio.digests(audio.features(audio.text_as_media(table))).collect()}
    for i, t in enumerate([*ODD, "same", "same"]):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-16:])
    assert got[len(ODD)]["feature"] == got[len(ODD) + 1]["feature"]
    x = RNG.integers(0, 256, 192 * 150, dtype=np.uint8)
    blocks, energy = audio.log_mel(x.tobytes())
    f = (x.astype(np.float32) - 128) / 128
    whole = np.append(audio.resample(f, 0, len(x) * 3 // 4), np.zeros(audio.FRAME))
    frames = np.stack([whole[i * audio.HOP : i * audio.HOP + audio.FRAME] for i in range(len(energy))]) * audio._hann()
    want = np.log(np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ audio._mel_bank() + 1e-6)
    assert np.allclose(blocks.reshape(-1, audio.MELS)[: len(energy)], want, atol=1e-4)
    assert audio.read_tensors(audio.tensors(blocks)).column("mel").combine_chunks().to_numpy_ndarray().shape == blocks.shape
    assert audio.segments(np.array([0.0, -7, -10, -7, 0, -7])) == [(0, 2), (4, 6)]


def test_crc_of_joined_bytes():
    for a, b in ((b"", b"x"), (b"abc", b""), (bytes(1000), bytes(range(256)))):
        assert content_store.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_chunks_follow_content():
    ids = RNG.integers(0, 50_000, 20_000).astype(np.uint16)
    moved = np.concatenate([RNG.integers(0, 50_000, 777).astype(np.uint16), ids])
    cut = lambda x: {x[a:b].tobytes() for own in content_store.cuts(x, np.array([len(x)])) for a, b in itertools.pairwise([0, *own])}
    assert len(cut(ids) & cut(moved)) > 5
    flat = np.zeros(30_000, np.uint16)
    assert max(np.diff([0, *content_store.cuts(flat, np.array([len(flat)]))[0]])) <= content_store.MOST


def test_a_repeated_passage_inside_one_sentence_is_cut(spark):
    passage, sentence, low = prose(60, stops=False), prose(60, stops=False) + ".", "la " * 59 + "la"
    around = [f"{prose(30, stops=False)} {{}} {prose(25, stops=False)}" for _ in range(3)]
    texts = [around[0].format(passage), around[1].format(passage), f"One. {sentence} {prose(20)}", f"{prose(9)}. {sentence} Two é.", prose(400, stops=False), "short one here. " + low, around[2].format(low)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(docs(spark, texts)).collect()}
    for i in (0, 2, 4):
        assert got[i] == texts[i]
    before, after = around[1].split(" {} ")
    assert got[1].startswith(before) and got[1].endswith(after)
    assert len(got[1].split()) - 55 <= 60 - 20
    assert got[3] == texts[3].replace(sentence + " ", "")
    assert "la la la la la la la la la la la la" not in got[6]


def test_a_table_of_copies_only_is_dealt_evenly(spark):
    rows = sharding.shard_documents(docs(spark, ["same text"] * 17)).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(sizes) == 16 and sorted(sizes.values()) == [1] * 15 + [2]


def test_rows_are_cleaned_by_their_own_text(spark):
    item = prose(30)
    rows = [(None, item), (None, "clean words"), (1, f"{item} and more"), (1, "also clean"), (2, None), (2, item)]
    table = spark.createDataFrame(rows, DOCS).withColumns(clashes())
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    left = decontamination.clean(table, bench)
    assert left.columns == table.columns
    assert sorted(r["text"] or "" for r in left.collect()) == ["", "also clean", "clean words"]


def test_ties_and_null_ids_are_dealt_evenly(spark):
    rows = [(None, "x")] * 40 + [(7, "x")] * 9 + [(8, "x"), (9, "é" * 50_000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 4).collect()
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    with pytest.raises(ValueError):
        sharding.shard_documents(docs(spark, []), 0)


def test_propagation_cuts_fewer_edges(spark):
    # Clusters of documents that share several keys with their cluster and one with others.
    rng = np.random.default_rng(3)
    members = [(d, f"c{d // 10}-{k}") for d in range(400) for k in range(3) if rng.random() < 0.8] + [(d, f"z{rng.integers(0, 200)}") for d in range(400)]
    rows = spark.createDataFrame([(d,) for d in range(400)], "doc_id long")
    links = spark.createDataFrame(members, "doc_id long, link_key string")

    def cut(rounds):
        shard = {r["doc_id"]: r["shard"] for r in sharding.propagate(rows, links, 8, rounds).collect()}
        assert set(collections.Counter(shard.values()).values()) == {50}
        by = collections.defaultdict(list)
        for d, k in members:
            by[k].append(shard[d])
        return sum(a != b for v in by.values() for a, b in itertools.combinations(v, 2))

    assert cut(3) < 0.75 * cut(0)


def spans_by_hand(text):
    """Character ranges of the sentences and pieces of a text, and its spans as (first, last + 1)."""
    whole = []
    for line in re.finditer(r"[^\n]+", text):
        at = line.start()
        for m in re.finditer(r"\S.*?(?:[.!?](?=\s)|$)", line[0], re.S):
            if m[0].strip():
                whole.append((at + m.start(), at + m.start() + len(m[0].rstrip())))
    return whole


def test_repeated_sentences_are_brute_force_s(spark):
    # Sentences of LONG words or less only, so that pieces are sentences.
    sentence = lambda: prose(int(RNG.integers(2, 13)), stops=False).capitalize() + "."
    pool = [sentence() for _ in range(30)]
    texts = []
    for _ in range(60):
        own = [sentence() for _ in range(int(RNG.integers(0, 6)))]
        begin = int(RNG.integers(0, 26))
        at = int(RNG.integers(0, len(own) + 1))
        texts.append(" ".join(own[:at] + pool[begin : begin + int(RNG.integers(0, 6))] + own[at:]))
    seen, want = {}, {}
    found = []
    for d, text in enumerate(texts):
        s = [text[a:b] for a, b in spans_by_hand(text)]
        n = [len(x.split()) for x in s]
        spans = set()
        for i in range(len(s)):
            for step in (1, -1):
                j = i
                while 0 <= j < len(s) and (abs(j - i) + 1 < substring_dedup.SENTENCES or sum(n[min(i, j) : max(i, j) + 1]) < substring_dedup.WORDS):
                    j += step
                if 0 <= j < len(s):
                    spans.add((min(i, j), max(i, j) + 1))
        found.append((s, spans))
        for a, b in spans:
            key = tuple(s[a:b])
            seen[key] = min(seen.get(key, (d, a)), (d, a))
    for d, (s, spans) in enumerate(found):
        gone = {k for a, b in spans if seen[tuple(s[a:b])] != (d, a) for k in range(a, b)}
        want[d] = " ".join(x for k, x in enumerate(s) if k not in gone)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(docs(spark, texts)).collect()}
    assert {d: t.strip() for d, t in got.items()} == want
    assert sum(want[d] != t for d, t in enumerate(texts)) > 10
