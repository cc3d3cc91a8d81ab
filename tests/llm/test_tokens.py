"""Ids of whole texts against the tokenizers library in its default setting."""

from __future__ import annotations

import zlib

from sylvameter.llm import packing, tokens


def test_added_tokens_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end}", f"one  {end}  two\n\n{end}\n", f"é <|endoftext {end}|> it's", "plain"]
    ids = {i: reader.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert ids[0] == [64, 50256, 65]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack_documents(df, tokens.byte_bpe_path()).collect()
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        whole = b"".join(x.to_bytes(4, "little") for x in [*ids[r.doc_id], 1])
        assert r.doc_tokens == len(whole) // 4 and r.ids_crc32 == zlib.crc32(whole[4 * r.start : 4 * (r.start + r.length)])


def test_long_white_space_and_whole_vocabulary_in_the_default_setting():
    """No setting of the library is changed: texts with and without added tokens, odd spaces, and runs of any length."""
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding, added = tokens.read_encoding(tokens.byte_bpe_path()), tokens.read_added(tokens.byte_bpe_path())
    long = [" " * 1_000_000, "a" + " " * 20_000 + "b", "\x1c" * 11_000 + "\n" * 30_000 + "x" + "\t" * 10_000, " \u2003\x85" * 9000 + "<|endoftext|>" + " " * 12_000, "x" * 200_000]
    for t in ["", "it's  I'LL\n\n\n a", "a\u00a0b\u3000c²½", "é ́ 𝒳 \x00", "日本語  テキスト", *long]:
        got = tokens.whole_ids_bytes(encoding, added, t)
        assert list(memoryview(got).cast("I")) == reader.encode(t, add_special_tokens=False).ids


def test_a_million_spaces_are_packed(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "a b")], "doc_id long, text string")
    got = packing.pack_documents(df, tokens.byte_bpe_path()).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 1_000_001 == next(r.doc_tokens for r in got if r.doc_id == 1)
