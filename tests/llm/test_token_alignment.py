import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from lodeline.llm import token_alignment
from lodeline.llm.queries import tokenizer_files
from lodeline.llm.token_alignment import Pair, align

FILES = (*tokenizer_files(), public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def plain(texts):
    """The rows of align() token by token, with the plain tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[3])
    one.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    for b in range(256):
        if b not in printable:
            byte[chr(256 + len(byte) - len(printable))] = b
    found, held = [], Counter()
    for text in texts:
        row = None
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
            bytes_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i) else other.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                spans = []
                for parts in (bytes_a, bytes_b):
                    ends = np.cumsum([len(p) for p in parts]).tolist()
                    spans.append(list(zip([0, *ends], ends, strict=False)))
                links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
                cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                groups, low = [], 0
                for cut in cuts:
                    groups.append("|".join(",".join(str(x) for x, (_, e) in zip(ids, own, strict=True) if low < e <= cut) for ids, own in zip((a, b), spans, strict=True)))
                    low = cut
                row = len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
                held.update(set(links))
        found.append(row)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(0, 0, 0, 0, "", 0, 0) if r is None else (*r[:3], len(r[3]), r[4], sum(held[k] == best[k[0]] for k in r[3]), sum(held[k] for k in r[3])) for r in found]


def aligned(spark, texts, **options):
    rows = align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), FILES, **options).collect()
    by_id = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(rows) == len(texts)
    return [by_id[i] for i in range(len(texts))]


def words(rng, n):
    return " ".join(rng.choice(["the", "a", "stone", "Zürich", "naïve", "x1", "日本語", "don't", "qzvlk", "2024-01-01", "=>", "<s>", "\U0001f600"]) for _ in range(n))


ODD = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "a <|endoftext|> b </s> <unk>", " nbsp", "▁ piece", "<0x41>", "\x00nul", "é ﬁ ①", "​", "word" * 500, "日本", "the", "the"]


@pytest.mark.parametrize(("block", "cell"), [(1 << 23, 1 << 22), (1 << 27, 300), (1 << 30, 1 << 22)])
def test_like_token_by_token(spark, block, cell):
    rng = random.Random(7)
    texts = [*ODD, *(words(rng, rng.randint(1, 60)) for _ in range(60)), *["the same text again"] * 30]
    assert aligned(spark, texts, block=block, cell=cell) == plain(texts)


def test_random_characters():
    """The two tokenizers' tokens and links over all kinds of characters."""
    pair, rng = Pair(*FILES), random.Random(3)
    kinds = [[chr(c) for c in range(0x20, 0x530)], list(" \t\n▁"), [chr(c) for c in (*range(0x2000, 0x2070), *range(0xFB00, 0xFB10), *range(0x1F600, 0x1F610))], list("abcdef 012")]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    found = token_alignment.Aligned(pair, texts, np.frombuffer(b"".join(data), np.uint8), offsets)
    expected = plain(texts)
    assert [(a, b, g, n, sha) for a, b, g, n, sha in zip(found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), found.sha, strict=True)] == [x[:5] for x in expected]
    assert sum(x[0] > 0 for x in expected) > 50


def test_a_long_text_and_hot_tokens(spark):
    """A text of a megabyte, and a text that a third of all rows share: portions of a stripe are dealt by run, the sums are the same."""
    rng = random.Random(1)
    texts = [words(rng, 150_000), *["the the the stone"] * 200, *(words(rng, 5) for _ in range(300))]
    got = aligned(spark, texts, cell=2000)
    assert len(texts[0].encode()) > 700_000 and got[0][0] > 150_000
    again = aligned(spark, texts)
    assert got == again and all(x == got[1] for x in got[1:201])


def test_ids_and_columns(spark):
    rows = [(None, "a b", 1), (None, "c", 2), (3, "a b", 3), (3, "d", 4), (3, "a b", 5)]
    got = align(spark.createDataFrame(rows, "doc_id long, text string, n_a int"), FILES)
    assert set(got.columns) == {"doc_id", *COLUMNS}
    assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in got.collect()) == [("3", 1, 1), ("3", 2, 6), ("3", 2, 6), ("None", 1, 1), ("None", 2, 6)]
    assert align(spark.createDataFrame([], "doc_id long, text string"), FILES).count() == 0
