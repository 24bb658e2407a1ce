import hashlib
import random
import re
from array import array
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loanmart.llm import token_align
from loanmart.llm.token_align import BYTE_LEVEL, PIECES, TOKENIZERS, _byte_alphabet


class Plain:
    """The same figures by loops over single tokens."""

    def __init__(self) -> None:
        self.a = Tokenizer.from_file(f"{TOKENIZERS}/{BYTE_LEVEL}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{PIECES}")
        self.letters = _byte_alphabet()

    def bytes_a(self, i):
        token = self.a.id_to_token(i)
        return bytes(self.letters[c] for c in token)

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, self.bytes_a(i)) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.bytes_b(i)) for i in self.b.encode(text)]
        wanted = (" " + text).encode()
        return (a, b) if all(b"".join(t for _, t in side) == wanted for side in (a, b)) else ([], [])

    @staticmethod
    def ends(side):
        at, out = 0, []
        for i, t in side:
            at += len(t)
            out.append((at, i))
        return out

    def report(self, docs):
        known, counts = [], Counter()
        for doc_id, text in docs:
            a, b = (self.ends(s) for s in self.tokens(text))
            both = sorted({e for e, _ in a} & {e for e, _ in b})
            links = [(i, j) for e, i in a for f, j in b if e == f] if len(a) < 2000 else [(dict(a)[e], dict(b)[e]) for e in both]
            groups, before = [], 0
            for e in both:
                inside = [",".join(str(i) for at, i in s if before < at <= e) for s in (a, b)]
                groups.append("|".join(inside))
                before = e
            known.append((doc_id, len(a), len(b), both, links, ";".join(groups)))
            counts.update(links)
        top = {}
        for (_, j), n in counts.items():
            top[j] = max(top.get(j, 0), n)
        return sorted(
            (d, na, nb, len(both), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "")
            for d, na, nb, both, links, g in known
        )


@pytest.fixture(scope="module")
def plain():
    return Plain()


def found(report):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in report.collect()), key=lambda t: (t[0] is not None, t))


def texts():
    rng = random.Random(5)
    letters = "abcde  \n\tÄéß漢字🙂'12<|>_ ▁"
    odd = ["", None, " ", "a", "<|endoftext|> and </s> <s> <unk> <0x0A>", "▁a b", "don't  stop\n\n\n now ", "🙂🙂 漢字", "nul \x00 here", "aaaa" * 500]
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*odd, *drawn, "the same text", "the same text"]


def test_equals_loops_over_tokens(docs_of, plain):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    got = found(token_align.align_report(docs_of(rows)))
    assert got == plain.report([(i, t) for i, t, _ in rows])
    by = {r[0]: r for r in got}
    assert by[0][1:] == by[1][1:] == by[5][1:] == (0, 0, 0, 0, 0, 0, "")
    assert by[4][1] > 10 and by[4][3] > 0


def test_equals_loops_on_documents(spark, data, plain):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.length("text") < 3000)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(token_align.align_report(docs)) == plain.report(rows)


def test_both_libraries_give_the_same_ids(spark, plain):
    byte_level, _ = token_align.load(spark)
    assert byte_level.ranked
    some = [" " + t for t in texts() if t]
    fast = byte_level.encoder()(some)
    byte_level.ranked = False
    assert fast == byte_level.encoder()(some)
    assert [list(array("i", ids)) for ids in map(bytes, fast)] == [plain.a.encode(t, add_special_tokens=False).ids for t in some]


def test_words_and_whole_texts_give_the_same(docs_of, spark, monkeypatch):
    byte_level, pieces = token_align.load(spark)
    assert pieces.by_word
    rows = [(i, t, "s") for i, t in enumerate([*texts(), "a\n b", "a \n", " ", "\t  b", "x  y\u00a0 z", "a\x1c b\u2003 c ", "'s 'll  \u3000 d"])]
    by_word = found(token_align.align_report(docs_of(rows)))
    monkeypatch.setattr(token_align, "_WORDS", re.compile(r"(?s).+"))
    assert found(token_align.align_report(docs_of(rows))) == by_word


def test_small_slices_and_partial_merges(docs_of, plain, monkeypatch):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    whole = found(token_align.align_report(docs_of(rows)))
    monkeypatch.setattr(token_align, "SLICE_BYTES", 40)
    monkeypatch.setattr(token_align, "MERGED_ROWS", 10)
    assert found(token_align.align_report(docs_of(rows).repartition(7))) == whole


def test_defined_cases(spark, docs_of):
    assert token_align.align_report(docs_of([])).count() == 0
    assert found(token_align.align_report(docs_of([(1, None, "s"), (2, "", None)]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    long = "many words of a very long text " * 60_000
    got = found(token_align.align_report(docs_of([(None, long, "s"), (7, "a b", "s"), (7, "a b", "s")])))
    assert got[0][0] is None and got[0][3] > 100_000
    assert got[1] == got[2] and got[1][5] == got[1][4]
    clash = spark.createDataFrame([(1, "x y", 5, 6)], "doc_id int, text string, a int, b int")
    assert found(token_align.align_report(clash))[0][3] > 0
