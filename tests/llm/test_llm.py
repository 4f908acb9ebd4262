import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import SMALL, assert_same
from pyspark.sql import functions as F

from textloom.llm import chat_format, decontaminate, license_scan, near_copies, ppm_score, quality_classifier, quality_rules, queries, sentencepiece_codec, simhash, suffix_dedup, token_counts

LONG = " ".join(f"w{i * 7919 % 613} the" for i in range(9000))
PASSAGE = "a passage of more than fifty bytes that stands in several of these texts, é and all"
ROWS = [
    (1, None, "en"),
    (2, "", None),
    (3, " \n\t ", "en"),
    (4, "one", "de"),
    (5, "one", "de"),
    (6, PASSAGE + " and then some more words", "en"),
    (7, "before it " + PASSAGE, "en"),
    (8, PASSAGE + PASSAGE, None),
    (9, LONG, "en"),
    (10, LONG + " end", "en"),
    (11, "MIT License\nLicensed under the Apache License, Version 2.0.\nGNU general public license", "en"),
    (12, "naïve Übung 東京 🙂 ▁ </s> <|endoftext|> it's WE'RE 12² \x00", "fr"),
    (12, "naïve Übung 東京 🙂 ▁ </s> <|endoftext|> it's WE'RE 12² \x00", "fr"),
    (None, PASSAGE, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars", "7 AS start", "8 AS key", "9 AS fp", "'x' AS word", "1 AS shard")
    return made.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def given(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_sentencepiece_equals_the_library(spark, docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    more = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = sentencepiece_codec.encode_ids(docs.select("doc_id", "text").unionByName(more), queries.PIECES).collect()
    want = sorted((model.encode(t) for _, t in given(docs) + given(more)), key=str)
    assert sorted((r["ids"] for r in rows), key=str) == want
    digests = sentencepiece_codec.encode_digests(docs, queries.PIECES).collect()
    assert sorted(r["decoded_sha256"] for r in digests) == sorted(hashlib.sha256(model.decode(model.encode(t)).encode()).hexdigest() for _, t in given(docs))
    assert sentencepiece_codec.encode_digests(none, queries.PIECES).count() == 0


def test_token_counts_equal_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_PIECES)
    more = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = token_counts.count_tokens(both, queries.WORD_PIECES).collect()
    want = Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in given(both))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert token_counts.count_tokens(none, queries.WORD_PIECES).count() == 0


def test_token_counts_of_very_long_words():
    import random

    from tokenizers import Tokenizer

    random.seed(4)
    library, counter = Tokenizer.from_file(queries.WORD_PIECES), token_counts.Counter(queries.WORD_PIECES)
    letters = lambda alphabet, n: "".join(random.choices(alphabet, k=n))
    texts = ["a" * 100_001, "ab" * 40_000 + " end", "x " + "é" * 5_000 + "!" * 70_000, "", letters("的一是在不了有和人这", 30_000)]
    texts += [letters("abcdefghijklmnopqrstuvwxyz", 200_000), letters(["the", "ing", "er", "qu"], 60_000), letters("ab", 60_000) + " " + letters("ab", 300), "short words stand here " * 40]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.counts(texts) == want
    import numpy as np

    symbols = np.frombuffer(letters("abc", 3_000).encode(), np.uint8).astype(np.int16)
    symbols[[700, 1900, 2999]] += token_counts.ENDS
    sums = [counter.merger.counts(symbols, chunk, section).sum() for chunk, section in ((256, 1 << 20), (7, 21), (16, 64), (4000, 4000), (1, 1))]
    assert len(set(sums)) == 1



def test_splitter_is_the_same_for_any_chunk():
    import numpy as np

    classes = np.random.default_rng(3).integers(0, 6, 5000).astype(np.uint8)
    state, want = 0, []
    for c in classes:
        want.append(state)
        state = token_counts.AFTER[state, c]
    for chunk in (1, 3, 64, 256, 10000):
        assert token_counts.splitter_states(classes, chunk).tolist() == want


def components(pairs):
    up = {i: i for i, _ in pairs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(pairs):
        for j, b in pairs[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i, _ in pairs}


def brute_fingerprint(text):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    prints = {i: brute_fingerprint(t) for i, t in given(docs) if i is not None}
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    want = components(sorted(prints.items()))
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in rows)
    assert simhash.near_duplicates(none).count() == 0


def brute_groups(rows):
    """Smallest doc_id of the texts that pairs of Jaccard similarity 0.8 or more over five-word shingles join."""
    sets, up = {}, {}
    for i, t in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", t.encode().lower()) if w]
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i in ids}


def test_near_copies_equal_brute_force(spark, docs, none):
    # near copies that digests of 3 bits miss, a chain, a crowd around it with outsiders, and a common line
    base = [f"v{i * 7919 % 1009}" for i in range(120)]
    made = [(100 + k, " ".join(base[: 120 - k] + [f"x{k}y{i}" for i in range(k)])) for k in range(24)]
    made += [(200 + k, " ".join(base[k:] + [f"z{i}" for i in range(k)])) for k in range(0, 120, 4)]
    made += [(500 + k, " ".join(base[:30] + [f"q{k % 20}w{i}" for i in range(9 - k % 3)])) for k in range(40)]
    more = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string")).unionByName(more)
    want = brute_groups([(i, t) for i, t in given(rows) if i is not None])
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(rows).collect()} == want
    kept = sorted(r["doc_id"] for r in near_copies.one_of_each_group(rows).collect() if r["doc_id"] is not None)
    assert kept == sorted(set(want.values())) and len(kept) < len(want)
    assert near_copies.one_of_each_group(none).count() == 0


def test_rows_that_share_a_doc_id_but_not_the_text_stay(spark):
    rows = [(1, "one text of some words here", "a"), (1, "another that has nothing in common", "b"), (2, "one text of some words here", "c"), (1, "one text of some words here", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(map(tuple, near_copies.one_of_each_group(docs.repartition(n)).collect())) for n in (1, 3)]
    assert kept[0] == kept[1] and sorted((i, t) for i, t, _ in kept[0]) == sorted({r[:2] for r in rows[:2]})


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    text = [f"v{i * 7919 % 1009}" for i in range(100)]
    rows = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:95], "five", "other", "words", "stand", "here"]))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, SMALL).collect()] == [1]


def test_near_duplicates_leave_no_shuffle_files(spark):
    import gc
    import time

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if re.search(r"/shuffle_\d+_\d+_\d+\.data$", f)}
    text = [f"v{i * 7919 % 1009}" for i in range(100)]
    rows = spark.createDataFrame([(i, " ".join([*text[: 100 - i], *(f"w{j}" for j in range(i))])) for i in range(1, 30)], "doc_id long, text string")
    before, held = shuffled(), gc.isenabled()
    gc.disable()  # what is left must not wait for a collection
    try:
        near_copies.one_of_each_group(rows)
        wait = time.time() + 20  # files go in the background
        while shuffled() - before and time.time() < wait:
            time.sleep(0.5)
        assert not shuffled() - before
    finally:
        if held:
            gc.enable()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_crowded_keys_link_like_pairs(spark):
    import random

    random.seed(5)
    base = random.getrandbits(64)
    fps = {base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 9))) for _ in range(120)} | {random.getrandbits(64) for _ in range(30)}
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from textloom.graph.components import connected_components

    groups = lambda links: {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    signed = [(f - (1 << 64) if f >> 63 else f, f) for f in fps]
    want = components(signed)
    for links in (simhash.near_links(rows), simhash.near_through_points(rows)):
        found = groups(links)
        assert {i: found.get(i, i) for i, _ in signed}.keys() == want.keys()
        same = defaultdict(set)
        for i, _ in signed:
            same[found.get(i, i)].add(want[i])
        assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(want.values()))


def brute_repeats(rows, length=50):
    first = {}
    for i, t in sorted((i, t.encode()) for i, t in rows if i is not None):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = []
    for i, t in rows:
        t = t.encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1) if i is not None else ():
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, docs, none):
    more = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(more)
    assert Counter(map(tuple, suffix_dedup.repeat_digests(both).collect())) == brute_repeats(given(both))
    assert suffix_dedup.repeat_digests(none).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_a_task_of_repeats_holds_few_copies_of_its_batch():
    import random
    import tracemalloc

    import pyarrow as pa

    draw, texts = random.Random(3), []
    while sum(map(len, texts)) < suffix_dedup.BATCH:
        texts.append("".join(map(chr, draw.choices(range(97, 123), k=40_000))))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    rows = sum(suffix_dedup.rows_in(data) for _, data in suffix_dedup.stretches(iter([batch]), 8, 50, 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows * 17 > suffix_dedup.BATCH and peak < 7 * suffix_dedup.BATCH


@pytest.mark.parametrize("piece", [60, 700, 10_000])
def test_repeats_are_the_same_for_any_piece(monkeypatch, piece):
    from textloom.llm.packed import unpack_all

    def gone():
        made = list(suffix_dedup.stretches(iter([batch]), 1, 50, 20))
        spans = [d for b, d in made if b < 0]
        for kind, data in suffix_dedup.settled(iter([(b, d) for b, d in made if b >= 0]), 50, suffix_dedup.WIDE, suffix_dedup.FULL):
            if kind == "remove":
                spans.append(data)
            else:
                ids, start, stop, gram = unpack_all([data])
                part = [texts[i][a:z].encode() for i, a, z in zip(ids.tolist(), start.tolist(), stop.tolist(), strict=True)]
                spans += suffix_dedup.compare([suffix_dedup.pack(ids, start, stop - start, gram)], part, 50)
        return {(i, k) for d in spans for i, a, z in zip(*(c.tolist() for c in unpack_all([d])), strict=True) for k in range(a, z)}

    import pyarrow as pa

    words = LONG[:6000]
    texts = [words, words[900:2900] + " between " + words[100:160] + words[4000:], "x" + words]
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2], "text": texts})
    whole = gone()
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    assert gone() == whole and (2, 1) in whole and (2, 0) not in whole


def test_wide_anchors_and_full_buckets(spark, docs):
    import numpy as np

    # 40 different stretches of one anchor are not for one task to compare
    n = np.arange(40)
    blob = suffix_dedup.pack(n, n.astype(np.uint32), np.full(40, 9, np.uint8), np.full(40, 7, np.uint64), n.astype(np.uint64))
    assert [k for k, _ in suffix_dedup.settle([blob], 50, 39)] == ["windows"]
    assert [k for k, _ in suffix_dedup.settle([blob], 50, 40)] == ["compare"]
    assert [k for k, _ in suffix_dedup.settled([(0, blob), (0, blob), (1, blob)], 50, 40, 60)] == ["later", "later", "compare"]

    # anchors are the least of 31 hashes; buckets are even all the same
    least = np.random.default_rng(1).integers(0, 1 << 48, (20_000, 31)).min(axis=1).astype(np.uint64)
    assert np.bincount(suffix_dedup.bucket_of(least, 20), minlength=20).max() < 1300

    ends = [(2000 + i, f"{i * 7919} begins {PASSAGE} ends {i * 104729}" + "a" * (40 + i)) for i in range(60)]
    more = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    both = docs.select("doc_id", "text").unionByName(more).unionByName(spark.createDataFrame(ends, "doc_id long, text string")).repartition(5).cache()
    want = brute_repeats(given(both))
    for wide, full in (3, 1 << 30), (1 << 30, 200), (3, 200):
        spans = suffix_dedup.repeated_spans(both, wide=wide, full=full).collect()
        gone = defaultdict(set)
        for r in spans:
            gone[r["doc_id"]] |= set(range(r["start"], r["stop"]))
        found = Counter()
        for i, t in given(both):
            t = t.encode()
            g = {k for k in gone[i] if k < len(t)}
            kept = bytes(c for k, c in enumerate(t) if k not in g)
            found[(i, len(t), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(kept).hexdigest())] += 1
        assert found == want


def contains(text, item, n=5, threshold=0.8):
    """(shingles of the item, of these found) where ``text`` holds ``item``, else None."""
    words, own = text.encode().lower().split(), item.encode().lower().split()
    k = min(n, len(own))
    want = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
    have = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    found = len(want & have)
    return (len(want), found) if want and found >= threshold * len(want) - 1e-9 else None


def test_leaks_equal_brute_force(spark, docs, none):
    import random

    random.seed(2)
    words = [f"i{k}" for k in range(60)]
    spread = " ".join(" ".join([*words[k : k + 9], *(f"f{random.randrange(10**6)}" for _ in range(150))]) for k in range(0, 60, 5))
    pieces = [(20, "so two plus two is four"), (21, spread), (22, " ".join(words)), (23, " ".join(words[:50])), (24, "Two plus  two"), (25, "two plus one two")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(pieces, "doc_id long, text string"))
    items = spark.createDataFrame([(1, PASSAGE), (2, "one"), (3, None), (4, ""), (5, "nothing of this stands anywhere at all"), (6, LONG), (7, "two plus two"), (8, " ".join(words)), (8, " ".join(words)), (9, "two two plus")], "item_id long, text string")
    rows = decontaminate.find_items(docs, items).collect()
    want = Counter((i, r["item_id"], *found) for i, t in given(docs) for r in items.collect() if (found := contains(t, r["text"] or "")))
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in rows) == want
    assert {(i, k) for i, k, *_ in want} >= {(20, 7), (24, 7), (21, 8), (22, 8)} and all(k != 9 for _, k, *_ in want)
    assert decontaminate.find_items(none, items).count() == 0 and decontaminate.find_items(docs, items.where("false")).count() == 0
    leaking = {i for i, *_ in want}
    assert {r["doc_id"] for r in decontaminate.without_items(docs, items).collect()} == {i for i, _ in given(docs)} - leaking


def test_chat_reads_back(spark):
    text = "</s>[INST] ok [/INST] \\ \\_ ▁ <|turn|>\x00 <s>"
    rows = [(1, 0, "user", text), (1, 1, "assistant", " " + text), (1, 2, "assistant", text), (2, 0, None, None), (2, 0, "user", "x"), (None, None, "assistant", "")]
    given_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat_format.conversation_digests(given_rows, queries.PIECES).collect()}
    turns = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])
    learnt = " " + text + text
    assert found[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert found[2]["n_turns"] == 2 and found[None]["n_turns"] == 1
    offsets = chat_format.with_offsets(chat_format.format_turns(given_rows, queries.PIECES)).collect()
    assert sorted(r["offset"] for r in offsets if r["conv_id"] == 1)[0] == 0


def test_base_scores(docs, none):
    rows = ppm_score.score_documents(docs).collect()
    words = lambda t: [w for w in re.split(rb"[\x20\x09-\x0D]+", t.encode().lower()) if w] + [0]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    known = Counter(w for i, t in given(docs) if not held(i) for w in words(t))
    want = Counter((i, len(words(t)), sum(known[w] > 0 for w in words(t)), known.total()) for i, t in given(docs))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert ppm_score.score_documents(none).count() == 0


def test_symbol_probabilities_sum_to_one():
    import numpy as np

    texts = [b"abracadabra", b"abacus", "naïve é".encode()]
    found, _ = ppm_score.codes(texts)
    seen, counts = ppm_score.tally([found], [np.ones(len(found), np.int64)])
    shallow = ppm_score.shallow_levels(ppm_score.tally([found & np.uint64(0xFFFFFF)], [np.ones(len(found), np.int64)]))
    context = np.uint64(int.from_bytes(b"abra", "big") << 8)
    every = context | np.arange(256, dtype=np.uint64)
    keys, all_counts = ppm_score.tally([seen, every], [counts, np.zeros(256, np.int64)])
    p = 10 ** ppm_score.log_probabilities(keys, all_counts, shallow)
    assert abs(p[np.isin(keys, every)].sum() - 1) < 1e-9


def brute_ppm(rows, held):
    """log10 probability of each text by an order-4 model with method C escapes and exclusion, in dictionaries."""
    from math import log10

    after = defaultdict(Counter)
    steps = lambda t: [((b"\0" * 4 + t.encode())[i : i + 4], c) for i, c in enumerate([*t.encode(), 255])]
    for i, t in rows:
        if not held(i):
            for context, c in steps(t):
                for o in range(5):
                    after[context[4 - o :]][c] += 1

    def score(t):
        total = 0.0
        for context, c in steps(t):
            gone = set()
            for o in range(4, -1, -1):
                seen = {k: n for k, n in after[context[4 - o :]].items() if k not in gone}
                weight = sum(seen.values()) + len(seen)
                if c in seen:
                    total += log10(seen[c] / weight)
                    break
                if seen:
                    total += log10(len(seen) / weight)
                gone |= set(seen)
            else:
                total -= log10(max(1, 256 - len(after[b""])))
        return total

    return [(i, score(t)) for i, t in rows]


def test_scores_equal_brute_force(spark, docs):
    from math import log10

    more = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id between 20 and 60")
    rows = docs.select("doc_id", "text").where("doc_id is null or doc_id < 9 or doc_id > 10").unionByName(more)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: [w for w in re.split(rb"[\x20\x09-\x0D]+", t.encode().lower()) if w] + [0]
    known = Counter(w for i, t in given(rows) if not held(i) for w in words(t))
    base = {(i, t): sum(log10((known[w] + 1) / (known.total() + len(known) + 1)) for w in words(t)) for i, t in given(rows)}
    found = sorted((r["doc_id"] or 0, r["score"], r["base_score"]) for r in ppm_score.score_documents(rows, 50_000, 20_000).collect())
    want = sorted((i or 0, x, base[i, t]) for (i, x), (_, t) in zip(brute_ppm(given(rows), held), given(rows), strict=True))
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) <= 1e-5 * abs(b[1]) + 1e-3 and abs(a[2] - b[2]) <= 1e-9 * abs(b[2])


def test_quality_counts(spark, docs, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.judge(docs, labels).collect()

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in rows) == Counter((i, *brute(t)) for i, t in given(docs))
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.judge(docs, labels.where("false")).count() == len(ROWS)


def test_binomial_bounds():
    from math import comb

    assert abs(quality_rules.binomial_tail(20, 3, 0.1) - sum(comb(20, i) * 0.1**i * 0.9 ** (20 - i) for i in range(4))) < 1e-12
    counts = {"a": (1000, [0, 2, 40]), "b": (30, [0, 0, 0]), None: (0, [0, 0, 0])}
    assert quality_rules.certified(counts, 0.01, 0.05) == {"a": 1}
    assert quality_rules.certified({"a": (10_000, [0, 0])}, 0.01, 0.05) == {"a": 1} and quality_rules.certified({}, 0.01, 0.05) == {}


def test_false_certifications_are_rarer_than_the_error():
    import numpy as np

    # strata whose first levels are safe and whose later ones reject just the risk or more
    draw, false, trials = np.random.default_rng(3), 0, 2000
    for _ in range(trials):
        rejected, bad = {}, {}
        for k in range(12):
            n, shares = 1500, ([0.0005, 0.01, 0.02], [0.0002, 0.001, 0.0101], [0.0001, 0.0002, 0.0003])[k % 3]
            first = draw.binomial(n, shares[0])
            more = [draw.binomial(n - first, max(0, (s - shares[0]) / (1 - shares[0]))) for s in shares[1:]]
            rejected[str(k)] = n, [first, first + more[0], first + max(more)]
            bad[str(k)] = next((i for i, s in enumerate(shares) if s >= 0.01), 3)
        false += any(at >= bad[k] for k, at in quality_rules.certified(rejected, 0.01, 0.05).items())
    assert false / trials <= 0.05


def test_learned_cutoffs_reject_and_keep(spark):
    good, junk = "plain words that read like any other line of prose number {}", "### $$$ %%% | | | &&& word {} ### $$$ | and some more words to be long enough"
    rows = [(i, (junk if i % 7 == 0 else good).format(i), "xx") for i in range(4000)] + [(9001, junk, "yy"), (9002, None, None), (9003, "few words", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(3500)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(found[i]["kept"] == (i % 7 != 0) for i in range(4000))
    assert found[9001]["kept"] and found[9001]["rejected_by"] == "" and not found[9002]["kept"] and found[9003]["base_failed"]
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in found.items() if r["kept"]}


def test_a_task_of_tokens_leaves_the_vocabulary_alone():
    import pyarrow as pa

    codec = sentencepiece_codec.codec(queries.PIECES)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [LONG, PASSAGE]})
    done = list(sentencepiece_codec.ids_of_batches(iter([batch]), queries.PIECES))
    assert done[0].column("lossless").to_pylist() == [True, True] and not codec.known and not codec.table.merges.known


def test_every_stratum_has_cutoffs(spark):
    good, junk = "plain words that read like any other line of prose number {}", "### $$$ %%% | | | &&& word {} ### $$$ | and some more words to be long enough"
    rows = [(s * 1000 + i, (junk if i % 10 == 0 else good).format(i), f"l{s:03}" if s else None) for s in range(115) for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 != 0) AS quality")
    found = quality_rules.judge(docs, labels, risk=0.2).collect()
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] % 10 != 0) for r in found)


def test_large_values_are_told_apart(spark):
    text = lambda i, n: " ".join(f"w{i}x{k}" + "#" * n for k in range(12))
    docs = spark.createDataFrame([(i, text(i, 60 if i % 10 == 0 else 25), "xx") for i in range(400)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 != 0) AS quality")
    found = quality_rules.judge(docs, labels, risk=0.1).collect()
    assert all(r["rejected_by"] == ("symbols" if r["doc_id"] % 10 == 0 else "") for r in found)


def test_certified_levels_equal_the_procedure(spark):
    import random

    draw = random.Random(5)
    for strata, risk in ((1, 0.01), (7, 0.01), (60, 0.1), (150, 0.02)):
        made = {None if k == 3 else f"l{k}": (n := draw.choice((80, 300, 700, 3000, 20_000)), sorted(int(n * risk * draw.random() ** 2 * draw.choice((0.3, 1, 1.6))) for _ in range(4))) for k in range(strata)}
        rows = spark.createDataFrame([(k, *v) for k, v in made.items()], "lang string, n long, rejected array<long>")
        found = {r["lang"]: r["level"] for r in quality_rules.certified_levels(rows, risk, 0.05).collect()}
        assert found == quality_rules.certified(made, risk, 0.05) and found
        tails = rows.select("n", F.explode("rejected").alias("k")).withColumn("tail", quality_rules.low_tail(F.col("n"), F.col("k"), risk))
        for n, k, tail in tails.collect():
            want = quality_rules.binomial_tail(n, k, risk)
            assert abs(tail - want) <= 1e-9 * want if k < n * risk else tail == 1 and want >= 0.5
    assert quality_rules.certified_levels(rows.where("false")).count() == 0


def test_classifier_on_held_out_rows(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality_classifier.score_quality(whole, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.score_quality(docs, labels).collect())
    assert quality_classifier.score_quality(docs, labels.where("false")).where("score = 1").count() == len(ROWS)


def test_license_cases(spark, docs, none):
    found = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (found[11]["n_base"], found[11]["first_word"], found[11]["base_labels"]) == (3, 0, "apache,gpl,mit")
    assert found[1]["n_words"] == 0 and found[1]["labels"] == "" and found[1]["first_word"] is None
    assert license_scan.scan(none).count() == 0
    import textwrap

    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    lines = textwrap.wrap(notice, 40)
    rows = [(1, notice), (2, "\n".join(lines)), (3, "\n".join("# " + x for x in lines)), (4, "/*\n" + "\n".join("   * " + x for x in lines) + "\n */"), (5, "word " * 300 + "\n".join(lines) + " word" * 300)]
    rows += [(6, "\n".join(lines[: len(lines) // 2])), (7, " far ".join(f"{w} {'x ' * 40}" for w in notice.split()))]
    # words of short templates in another order, or with others between them, are no notice
    rows += [(8, "all our rights are reserved to all"), (9, "rights all the reserved wood"), (10, "(c) 2020 X. ALL RIGHTS\n # reserved."), (11, "y " * 40 + "Licensed under CC-BY-NC 4.0")]
    rows += [(12, "4 0 licensed works by nc under cc"), (13, "You may not use this file, licensed under the\nApache License Version 2.0 (the License), except in compliance with the License")]
    met = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert met == {1: "mit", 2: "mit", 3: "mit", 4: "mit", 5: "mit", 6: "", 7: "", 8: "", 9: "", 10: "reserved", 11: "cc", 12: "", 13: "apache"}


def test_stages_on_nothing_and_on_clashing_columns(spark, docs, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0, name
    more = docs.selectExpr("*", "'a' AS spans", "1 AS wanted", "2 AS maybe", "3 AS row_hash2", "'r' AS rest")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SMALL)
        assert out.columns == more.columns and out.count() <= len(ROWS), name
    cut = {r["doc_id"]: (r["text"], r["spans"], r["n_chars"]) for r in suffix_dedup.without_repeats(more).where("doc_id in (6, 7)").collect()}
    assert cut[6] == (PASSAGE + " and then some more words", "a", len(PASSAGE) + 25) and PASSAGE not in cut[7][0] and cut[7][2] == len(cut[7][0])


def test_chat_on_nothing_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 1, "assistant", "b", 6)], "conv_id long, turn long, role string, text string, offset int")
    found = chat_format.conversation_digests(rows, queries.PIECES).collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in found] == [(2, 1)] and found[0]["formatted_chars"] > 2
    assert chat_format.conversation_digests(rows.where("false"), queries.PIECES).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    assert out.where("NOT lossless").count() == 0 and 0 < out.count() <= spark.read.parquet(f"{SMALL}/documents.parquet").count()
