"""Alignment against spans and plain counting with the tokenizers themselves, and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sylvameter.llm import alignment, queries, tokens
from sylvameter.llm.tokencount import piece_path
from sylvameter.sources.tables import table

DOCS = "doc_id long, text string, lang string, row int, links string, n_a string, groups int"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class _Plain:
    """The contract by its words: spans of tokens, and all pairs that end together."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path())
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [x for x in range(256) if x not in plain]
        self.byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}

    def spans(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = []
        for p in map(self.b.id_to_piece, b):
            bytes_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
        return a, b, bytes_a, bytes_b

    def document(self, text):
        """(a, b, groups, links as (a id, b id), overlaps)"""
        if not text:
            return [], [], [], [], 0
        a, b, bytes_a, bytes_b = self.spans(text)
        whole = b" " + text.encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], [], [], [], 0
        ends_a, ends_b = (list(np.cumsum([len(x) for x in y])) for y in (bytes_a, bytes_b))
        links = [(a[i], b[j]) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if e == f]
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([x for x, e in zip(a, ends_a, strict=True) if start < e <= cut], [x for x, e in zip(b, ends_b, strict=True) if start < e <= cut]))
            start = cut
        overlaps = sum(max(e - len(x), f - len(y)) < min(e, f) for x, e in zip(bytes_a, ends_a, strict=True) for y, f in zip(bytes_b, ends_b, strict=True))
        return a, b, groups, links, overlaps

    def corpus(self, rows):
        found = [(doc_id, *self.document(text)) for doc_id, text in rows]
        counts = Counter(link for *_, links, _ in found for link in links)
        most = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        for doc_id, a, b, groups, links, _ in found:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            best = sum(counts[x] == most[x[1]] for x in links)
            yield doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""


@pytest.fixture(scope="module")
def plain():
    return _Plain()


TEXTS = [
    None, "", " ", "  two  spaces ", "the cat sat on the mat", "the cat sat on the mat", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "tab\tline\nend\r\n\n", "日本語 é́ 𝒳 ünï",
    "\x00 nul", "\x7f\x01​ 　x", "ﬁ ½ Å", "naïve—“quotes” …", "x" * 3000, "word " * 2000, "0123456789" * 50, "</s>", " ", "▁",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, repeated rows, null ids, and columns named like those of the operator."""
    rows = [(i, t, "en", i, "clash", "z", None) for i, t in enumerate(TEXTS)] + [(None, "orphan row", None, None, None, None, 1), (4, "the cat", "en", 0, "", "", 0), (4, "the cat", "en", 0, "", "", 0)]
    return spark.createDataFrame(rows, DOCS)


def _rows(df):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


def test_corpus_is_that_of_spans(spark, odd, plain):
    small = odd.where("text is null or length(text) < 500")
    wanted = Counter(plain.corpus([(r.doc_id, r.text) for r in small.collect()]))
    for most_pairs in (1_000_000, 20):  # all pairs broadcast, or the most frequent alone
        assert _rows(alignment.align_corpus(small, tokens.byte_bpe_path(), piece_path(), most_pairs)) == wanted
    assert alignment.align_corpus(odd.limit(0), tokens.byte_bpe_path(), piece_path()).count() == 0
    assert alignment.align_corpus(odd, tokens.byte_bpe_path(), piece_path()).count() == odd.count()


def test_alignments_of_odd_texts(odd, plain):
    got = alignment.align_tokens(odd, tokens.byte_bpe_path(), piece_path(), "doc_id", "text").collect()
    assert len(got) == odd.count()
    for r in got:
        if len(r.text or "") > 500:
            continue
        a, b, groups, links, overlaps = plain.document(r.text)
        assert (r.n_a, r.n_b, r.n_groups, r.n_overlaps, r.n_links) == (len(a), len(b), len(groups), overlaps, len(links)), r.text
        assert r.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert Counter({(x.a, x.b): x.n for x in r.links}) == Counter(links)


def test_owner_changes_in_windows_of_any_size():
    rng = random.Random(7)
    for _ in range(60):
        size = rng.randint(1, 60)
        ends_a, ends_b = (np.array(sorted({size, *rng.sample(range(1, size + 1), rng.randint(0, size))})) for _ in range(2))
        shared = sorted(set(ends_a) & set(ends_b))
        for window in (1, 2, 7, 100):
            overlaps, last_a, last_b = alignment.owner_changes(ends_a, ends_b, window)
            assert overlaps == len(set(ends_a) | set(ends_b))
            assert list(ends_a[last_a]) == list(ends_b[last_b]) == shared
        assert list(alignment.byte_owners(ends_a, 0, size)) == [int(np.searchsorted(ends_a, i, side="right")) for i in range(size)]


def test_long_text_without_white_space(spark):
    aligner = alignment.Aligner(tokens.byte_bpe_path(), piece_path())
    text = "abcdefghij" * 30_000 + " é" * 50_000
    (found,) = aligner.align([text])
    assert sum(map(len, (aligner.sides[0].pieces[i] for i in found.a))) == len(text.encode()) + 1
    assert aligner.groups_text(found).count(";") == len(found.last_a) - 1


def test_query(spark, data, plain):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").collect()]
    short = [(i, t) for i, t in rows if t is None or len(t) < 3000]
    got = _rows(queries.op11_token_alignment(spark, data))
    assert sum(got.values()) == len(rows)
    by_id = {r[0]: r for r in got}
    for doc_id, n_a, n_b, n_groups, n_links, *_, digest in plain.corpus(short):
        assert by_id[doc_id][1:5] == (n_a, n_b, n_groups, n_links) and by_id[doc_id][-1] == digest
    # counts of the whole table, added up from the alignments of the query's operator
    pairs = Counter()
    for r in alignment.align_tokens(table(spark, data, "documents"), tokens.byte_bpe_path(), piece_path()).select("links").collect():
        pairs.update({(x.a, x.b): x.n for x in r.links})
    assert sum(r[6] * k for r, k in got.items()) == sum(n * n for n in pairs.values())
