import hashlib
from collections import Counter, defaultdict

import pytest
from oracle import SMALL
from test_llm import ROWS

from textloom.llm import queries, token_alignment

MORE = [(20, "tail \U00031350\U0001fae8 ᲊ ꟍ²Ⅷ१२ ᠎​\u0085  x"), (21, "<s>[INST] <0x0A> ▁ </s>"), (22, "ab" * 20000), (23, "  \t\n  lines\r\n\n of \x00 it's it'S "), (24, "é ﻿ 　全角　スペース")]


def pieces():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def brute(rows):
    a, b = pieces()
    letters = {chr(k): k for k in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): k for i, k in enumerate(k for k in range(256) if chr(k) not in letters)}
    links, groups, sizes = [], [], []
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            ids_a, ids_b = [], []
        own, written, i, j, end_i, end_j, part_a, part_b = [], [], 0, 0, 0, 0, [], []
        while i < len(ids_a):
            if not part_a and not part_b:
                part_a, part_b, end_i, end_j = [ids_a[i]], [ids_b[j]], end_i + len(bytes_a[i]), end_j + len(bytes_b[j])
            own.append((ids_a[i], ids_b[j]))
            if end_i == end_j:
                written.append(",".join(map(str, part_a)) + "|" + ",".join(map(str, part_b)))
                i, j, part_a, part_b = i + 1, j + 1, [], []
            elif end_i < end_j:
                i += 1
                part_a.append(ids_a[i])
                end_i += len(bytes_a[i])
            else:
                j += 1
                part_b.append(ids_b[j])
                end_j += len(bytes_b[j])
        links.append(own)
        groups.append(written)
        sizes.append((len(ids_a), len(ids_b)))
    n, most = Counter(p for own in links for p in set(own)), defaultdict(int)
    for (x, _), k in n.items():
        most[x] = max(most[x], k)
    return Counter(
        (i, *size, len(g), len(own), sum(n[p] == most[p[0]] for p in own), sum(n[p] for p in own), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (i, _), own, g, size in zip(rows, links, groups, sizes, strict=True)
    )


@pytest.mark.parametrize("batch", [5000, token_alignment.BATCH])
def test_rows_equal_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(token_alignment, "BATCH", batch)
    given = [(r[0], r[1]) for r in ROWS] + MORE + MORE[:1]
    given += [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "'k' AS key", "1 AS batch", "2 AS copies", "3 AS a", "4 AS n_a").repartition(3)
    rows = token_alignment.align_tokens(docs, queries.BYTES, queries.PIECES)
    assert Counter(tuple(r) for r in rows.collect()) == brute(given)


def test_both_libraries_split_alike():
    own, (library, _) = token_alignment.ByteLevel(queries.BYTES), pieces()
    assert own.fast is not None
    texts = ["".join(f"{chr(c)}a{chr(c)}1 {chr(c)}{chr(c)}! {chr(c)}" for c in range(k, k + 997) if not 0xD800 <= c < 0xE000) for k in range(1, 0x32000, 997)]
    assert [own.encode(t).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_rows_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert token_alignment.align_tokens(docs.where("false"), queries.BYTES, queries.PIECES).count() == 0
    assert sorted(tuple(r) for r in token_alignment.align_tokens(docs, queries.BYTES, queries.PIECES).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
