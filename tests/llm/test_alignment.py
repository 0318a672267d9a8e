import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessel.llm import token_alignment
from tessel.llm.queries import QUERIES

from .helpers import AWKWARD, corpus

SMALL = "/root/testdata/sf0.001"


def files():
    read = lambda name: open(public_tokenizers.path(name), "rb").read()  # noqa: E731, SIM115
    return read("byte_bpe_50k.json"), public_tokenizers.PATTERN, read("piece_bpe_32k.model")


def plain(texts):
    """The contract with both libraries on whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_alignment.byte_letters()
    rows, links = [], []
    for text in texts:
        raw, own, groups = f" {text}".encode(), [], []
        one, two = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in one]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            one = two = []
        ends_a = {sum(map(len, bytes_a[: k + 1])): i for k, i in enumerate(one)}
        ends_b = {sum(map(len, bytes_b[: k + 1])): i for k, i in enumerate(two)}
        last = 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(i) for e, i in sorted(ends.items()) if last < e <= cut) for ends in (ends_a, ends_b)))
            own.append((ends_a[cut], ends_b[cut]))
            last = cut
        rows.append((len(one), len(two), len(groups), ";".join(groups)))
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(*r[:3], len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), r[3]) for r, own in zip(rows, links, strict=True)]


def facts(df):
    return [tuple(r) for r in df.orderBy("row.at").select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]


def texts():
    rng = random.Random(8)
    letters = [" ", " ", "\n", "\t", "  ", "a", "the", "tion", "é", "ñ", "東京", "🙂", "<|endoftext|>", "<s>", "1", "...", " ", "\u0000", "\r\n", "ﬁ", "'s"]
    odd = ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(120)]
    return [t for _, t in corpus(2, 15, 10)] + odd + ["", None, " ", "   ", "\n", " \n ", "a▁b", "plain ▁", "x" * 3000, " " * 700 + "end", "same same", "same same"] + [t for _, t in AWKWARD]


@pytest.mark.parametrize("table", ["looked up", "joined"])
def test_same_as_both_libraries_token_by_token(spark, table):
    given = texts()
    rows = spark.createDataFrame([(i, t, 1, "g") for i, t in enumerate(given)], "at int, text string, pairs int, `n.a` string")
    limit = {} if table == "looked up" else {"broadcast_pairs": 10}
    out = token_alignment.align_documents(rows, *files(), readable=True, **limit)
    assert facts(out) == plain(given)
    assert out.select("row.*").columns == ["at", "pairs", "n.a"]
    hashed = token_alignment.align_documents(rows, *files(), **limit)
    assert [x[6] for x in facts(hashed)] == [hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "" for x in plain(given)]


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_alignment, "MEMORY", 20)
    pieces = token_alignment.Pieces(files()[2])
    given = [t or "" for t in texts()]
    made = [x for k in range(0, len(given), 9) for x in pieces.encode(given[k : k + 9])]
    for t, own in zip(given, made, strict=True):
        whole = pieces.model.encode(t)
        assert own is None or np.frombuffer(own, "<u4").tolist() == whole or not t
        assert (own is None) == ("▁" in t)
    pieces.split = None
    assert [x or b"" for x, t in zip(pieces.encode(given), given, strict=True) if t] == [x or b"" for x, t in zip(made, given, strict=True) if t]


def test_tokens_without_bytes_link_with_all_that_end_there():
    a, b = np.array([1, 0, 2]), np.array([2, 0, 1])
    got = token_alignment.align(a, b, np.array([0, 1, 2]), np.array([0, 1, 2]))
    assert got.cuts.tolist() == [3] and sorted(zip(got.left.tolist(), got.right.tolist(), strict=True)) == [(2, 2)]
    got = token_alignment.align(np.array([2, 0, 1]), np.array([2, 1, 0]), np.array([0, 1, 2]), np.array([0, 1, 2]))
    assert sorted(zip(got.left.tolist(), got.right.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2)]


def test_counts_in_two_stages(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "COUNTED", 5)
    rng, rows, want = random.Random(2), [], Counter()
    for _ in range(40):
        own = {rng.choice([3, 7, 7, rng.randrange(40)]): rng.randrange(1, 4) for _ in range(6)}
        rows.append((bytearray(np.array(sorted(own), "<u8").tobytes()), bytearray(np.array([own[k] for k in sorted(own)], "<u4").tobytes())))
        want.update(own)
    most = {b: max(n for p, n in want.items() if p % 4 == b) for b in {p % 4 for p in want}}
    got = token_alignment.count_pairs(spark.createDataFrame(rows, "pairs binary, times binary").repartition(7), 4).collect()
    assert sorted(got) == sorted((p, n, n == most[p % 4]) for p, n in want.items())


def test_no_documents_and_a_dotted_text_column(spark):
    rows = spark.createDataFrame([(1, "the text here")], "id long, `a.text` string")
    assert token_alignment.align_documents(rows, *files(), text_col="a.text").count() == 1
    assert token_alignment.align_documents(rows.limit(0), *files(), text_col="a.text").count() == 0


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        token_alignment.ByteLevel(b'{"model": {"vocab": {"a": 0, "ab": 300}, "merges": [["a", "b"]]}}', "a")


def test_query_against_both_libraries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    want = plain([r.text for r in docs])
    found = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SMALL).collect()}
    for r, w in zip(docs, want, strict=True):
        x = found[r.doc_id]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum) == w[:6]
        assert x.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
    assert len(found) == len(docs)
