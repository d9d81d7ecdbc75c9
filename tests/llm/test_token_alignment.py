"""Alignment against owners found byte by byte over whole texts encoded by the libraries, and its odd cases."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm import queries, token_alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    spell, alphabet = {i: t for t, i in tok.get_vocab().items()}, token_alignment.byte_level_alphabet()

    def links(text):
        """Groups as lists of ids, and linked pairs of ids."""
        if not text:
            return [], []
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        a_bytes = [bytes(alphabet[c] for c in spell[i]) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return [], []
        spans = [[(i, sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k, i in enumerate(ids)] for ids, x in ((a, a_bytes), (b, b_bytes))]
        pairs = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append([[i for i, s, e in x if start <= s and e <= end] for x in spans])
            start = end
        return groups, pairs

    def table(docs):
        made = [(key, *links(t)) for key, t in docs]
        counts = Counter(p for _, _, pairs in made for p in pairs)
        most = {b: max(n for (_, x), n in counts.items() if x == b) for b in {b for _, b in counts}}
        out = []
        for key, groups, pairs in made:
            text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
            sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
            out.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha))
        return sorted(out, key=repr)

    return table


ODD = ["Hello world", "", None, " ", "  ", " lead", "trail ", "a  b   c", "tab\t x \n\n y", "\n\n", "x ▁ y", "<|endoftext|> and </s> <unk>", "私は魔女です。 Ünïcode ⁇ été", "NUL \x00 here", "\x00", "don't  stop'll I'VE", "😀 👩‍👩‍👧 ok", "a b 　 c", "a \u0085 b", "   x", "z" * 300, "1 2 3 4567890", "a \x1c b", "ab " * 40, "Hello world", "ﷺ ﬁ Å �"]


def spark_rows(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pairs", "3 AS `KEY`", "4 AS n").repartition(3)
    made = queries.written(token_alignment.align_tokens(df, A, B), "aligned")
    counts = queries.written(token_alignment.pair_counts(made), "pairs")
    out = made.join(token_alignment.link_scores(made, counts), "row", "left").fillna(0, ["n_best", "count_sum"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return sorted(map(tuple, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest).collect()), key=repr)


@pytest.mark.parametrize("few", [3_000_000, 0])
def test_odd_texts_against_brute_force(spark, brute, monkeypatch, few):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", few)
    docs = [(k, t) for k, t in enumerate(ODD)] + [(0, "Hello world"), (0, "Hello world"), (None, "Hello there"), (None, None)]
    assert spark_rows(spark, docs) == brute(docs)


def test_of_nothing(spark):
    assert spark_rows(spark, [])== []


def test_query_against_brute_force(spark, brute):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf).collect()]
    docs = [(k, t) for k, t in docs if len(t or "") < 1500]
    got = {r["doc_id"]: r for r in queries.op11_token_alignment(spark, sf).collect()}
    assert len(got) == queries.documents(spark, sf).count()
    want = brute(docs)
    for key, n_a, n_b, n_groups, n_links, _, _, sha in want:
        assert [got[key][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == [n_a, n_b, n_groups, n_links, sha]
    assert spark_rows(spark, docs) == want
