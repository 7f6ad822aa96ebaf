"""Alignment of two tokenizers against whole-text encodings and an all-pairs version."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from longform.llm import token_align
from longform.llm.tokens import byte_bpe, public_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [None, "", " ", "a", "Hello  world", " lead", "trail ", "tab\t tab\n\n x", "x <|endoftext|> </s> y <s>",
         "été 　 wide", "a▁b", "ﬁne ½ ①", "word " * 2000, "z" * 3000, "你好吗" * 300, "🙂🙃 emoji", "é combining",
         "one two", "one two", "nul\x00 byte", "a   b", "end\n"]


@pytest.fixture(scope="module")
def brute():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    raw = byte_bpe(public_path("byte_bpe_50k.json"), plain=True).bytes_of

    def one(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [raw[i] for i in ids_a], [token_align.piece_bytes(b.id_to_piece(i)) for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            return None
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, span) if low <= s and e <= end)
                                   for ids, span in ((ids_a, spans[0]), (ids_b, spans[1]))))
            low = end
        links, j0 = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(ids_b) and spans[1][j][0] < e:
                links.append((i, ids_b[j]))
                j += 1
        return len(ids_a), len(ids_b), groups, links

    def run(rows):
        done = [(key, one(text)) for key, text in rows]
        count = Counter(p for _, x in done if x for p in set(x[3]))
        best = defaultdict(int)
        for (i, _), n in count.items():
            best[i] = max(best[i], n)
        out = []
        for key, x in done:
            if not x:
                out.append((key, 0, 0, 0, 0, 0, 0, ""))
                continue
            n_a, n_b, groups, links = x
            out.append((key, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                        sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        return sorted(out, key=str)
    return run


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_slices_and_links_of_crossing_ends():
    assert token_align.common_slices([2, 5, 6, 9], [3, 6, 8, 9]) == ([6, 9], [3, 4], [2, 4])
    ends, a, b = token_align.links_of([2, 5, 6, 9], [3, 6, 8, 9])
    assert ends.tolist() == [2, 3, 5, 6, 8, 9]
    assert list(zip(a, b)) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (3, 3)]


def test_equals_brute_force(spark, brute):
    rng = random.Random(11)
    alphabet = ["a", "b", "'s", "9", ".", " ", " ", "  ", "\n", "\t", " ", "ß", "好", "̈", "🙂", "<s>", "the", "tion"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(600)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_links string")
    for links in (1 << 20, 300):
        assert rows_of(token_align.align_documents(df.repartition(3), block_links=links)) == brute(rows)


def test_edges(spark, brute):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align_documents(empty).count() == 0
    rows = [(None, "same text"), (1, "same text"), (1, "other"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert rows_of(token_align.align_documents(df)) == brute(rows)
    none = spark.createDataFrame([("k", None), ("l", "")], "doc_id string, text string")
    assert rows_of(token_align.align_documents(none)) == brute([("k", None), ("l", "")])


def test_query(spark, brute):
    import duckdb

    from longform.llm import queries
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    assert rows_of(queries.queries()["op13_cross_tokenizer_alignment"](spark, sf)) == brute(rows)
