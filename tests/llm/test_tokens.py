"""Token ids, counts and segmentation against the libraries and plain code."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from tallybook.llm import catalog, dac, token_counts, token_output, unigram  # noqa: E402
from tallybook.llm.vocabulary import token_pattern, tokenizer_path  # noqa: E402

TRICKY = [
    None, "", " ", "a", " lead", "trail ", "two  spaces", "line \n next", "\n\n\n a\tb\n", "x\n \ny", "don't we'll",
    "日本語 🎉 text", "a b 　c", "<|endoftext|> ok", "▁ literal ▁x", "é" * 50, "word " * 5000, "\x00 zero",
]


def table(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TRICKY)], "doc_id bigint, text string, ids string")


@pytest.mark.parametrize("width", [8, 16])
def test_codes(width):
    draw = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        numbers = (2.0 ** draw.uniform(0, 32, n)).astype(np.uint32)
        codes = dac.Codes(dac.encode(numbers, width))
        places = draw.permutation(n)
        assert (codes.access(places) == numbers[places]).all()
        for _ in range(20):
            a, b = sorted(draw.integers(0, n + 1, 2))
            assert (codes.between(int(a), int(b)) == numbers[a:b]).all()


def test_token_files(spark, tmp_path, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rows = [(9 - i, t) for i, t in enumerate(TRICKY)] + [(3, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    token_output.write(docs, str(tmp_path / "t"), path)
    got = sorted(token_output.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    token_output.write(nothing, str(tmp_path / "n"), path)
    assert token_output.read(spark, str(tmp_path / "n")).count() == 0


def test_token_query(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = {r["doc_id"]: r for r in catalog.queries()["op8_token_output"](spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        own = got[r["doc_id"]]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_special_tokens_of_the_query_as_the_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [*TRICKY, end, f"a{end}b", f"a {end} b", f"a b {end}", f"{end}{end} c", f"x\n{end}\n y", f" {end}b a{end} b", "a  b"]
    texts += [f"w{k} {end}{k} v{end} <|endof text|>" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in catalog.queries()["op8_token_output"](spark, str(tmp_path)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[i]
        assert (own["start"], own["n_tokens"], own["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def best(model, vocabulary, text: str) -> list[int]:
    """Plain Viterbi over each stretch of markers and the characters after it."""
    out = []
    for part in unigram.UNIT.findall(" " + text) if text else []:
        if part == unigram.MARK:
            out += model.byte_ids[list(part.encode())].tolist()
            continue
        s = part.replace(" ", unigram.MARK)
        score, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
        for a in range(len(s)):
            for b in range(a + 1, min(len(s), a + 64) + 1):
                i = vocabulary.get(s[a:b])
                gain = model.scores[i] if i is not None else model.unknown if b == a + 1 else None
                if gain is not None and score[a] + gain > score[b]:
                    score[b], back[b] = score[a] + gain, (a, i)
        ids, end = [], len(s)
        while end:
            a, i = back[end]
            ids = ([i] if i is not None else model.byte_ids[list(s[a:end].encode())].tolist()) + ids
            end = a
        out += ids
    return out


def test_segmentation(spark, sf_dir, nothing):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = unigram.Model.load(path)
    source = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = {
        source.id_to_piece(i): i
        for i in range(source.get_piece_size())
        if not (source.is_byte(i) or source.is_control(i) or source.is_unknown(i))
    }
    for r in unigram.encoded(table(spark), path).collect():
        text = TRICKY[r["doc_id"]]
        assert r["decoded"] == text
        assert r["ids"] == (None if text is None else best(model, vocabulary, text))
        assert r["n_tokens"] == len(r["ids"] or [])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = unigram.encoded(docs, path)
    assert coded.filter("decoded <> text OR decoded IS NULL").count() == 0
    for r in coded.orderBy("doc_id").limit(15).collect():
        assert r["ids"] == best(model, vocabulary, r["text"])
    assert unigram.encoded(nothing, path).count() == 0


def counted(parts: list[str | None]) -> tuple:
    """Tokens of the joined fields, each given to a section by its characters."""
    import base64

    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    coder = tiktoken.Encoding("t", pat_str=token_pattern(), mergeable_ranks=ranks, special_tokens={})
    present = [(k, p) for k, p in enumerate(parts) if p is not None]
    text, sections, owner = "\n".join(p for _, p in present), [], []
    for at, (k, p) in enumerate(present):
        own = p + "\n" * (at < len(present) - 1)
        lines = re.findall(r"[^\n]*\n|[^\n]+", own) or [""]
        sections += lines
        owner += [k] * len(lines)
    of_char = [s for s, line in enumerate(sections) for _ in line]
    counts, crossing, byte = [0] * len(sections), 0, 0
    of_byte = [c for c, ch in enumerate(text) for _ in ch.encode()]
    for token in coder.encode_ordinary(text):
        size = len(coder.decode_single_token_bytes(token))
        chars = sorted({of_byte[b] for b in range(byte, byte + size)})
        started = [c for c in chars if byte == 0 or of_byte[byte - 1] != c] or chars
        where = [of_char[c] for c in started]
        crossing += len(set(where)) > 1
        counts[max(sorted(set(where)), key=where.count)] += 1
        byte += size
    return sum(counts), crossing, counts, owner


def test_token_counts(spark, nothing):
    texts = [*TRICKY, "a\n\n\n\n\nb", "end\n\n\n", "\n\n\n\n", "x \n\n\n \n\n y"]
    draw = random.Random(2)
    rows = [(i, draw.choice(["t", "", None, "a\n\n"]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    got = token_counts.counted(df, tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern(), ("title", "text"))
    for r in got.collect():
        n, crossing, sections, owner = counted([r["title"], r["text"]])
        assert (r["n_tokens"], r["n_crossing"], r["section_tokens"]) == (n, crossing, sections), r
        assert r["section_field"] == owner
        for k, field in enumerate(("title", "text")):
            want = None if r[field] is None else sum(c for c, o in zip(sections, owner) if o == k)
            assert r["field_tokens"][k] == want
    empty = nothing.selectExpr("doc_id", "text AS title", "text")
    assert token_counts.counted(empty, tokenizer_path("byte_bpe_50k.tiktoken"), token_pattern(), ("title",)).count() == 0


def texts_with_double_spaces(count: int) -> list[str]:
    draw = random.Random(4)
    words = ["the", "Tree's", "é日本", "123", "a\tb", "x\n", "　wide", "end.", "▁m", "<|endoftext|>", "z" * 90]
    out = []
    for k in range(count):
        row = [draw.choice(words) if draw.random() < 0.8 else f"w{k}x{draw.randrange(1000)}" for _ in range(12)]
        out.append(draw.choice(["", " ", "  "]) + "".join(w + draw.choice([" ", " ", " ", "  ", " \n", "\t "]) for w in row))
    return out


def test_double_spaces_leave_a_bounded_store():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tallybook.llm import units

    path = tokenizer_path("byte_bpe_50k.json")
    library, store = Tokenizer.from_file(path), token_output._store(path, False)
    store = units.UnitStore(store.encode, limit=2 << 20)
    texts = texts_with_double_spaces(50_000)
    done = 0
    for a, b, ids, counts in units.encoded_texts(pa.array(texts), store, piece_bytes=1 << 20):
        ends = counts.cumsum()
        for k in range(a, b, 17):
            assert ids[ends[k - a] - counts[k - a] : ends[k - a]].tolist() == library.encode(texts[k], add_special_tokens=False).ids
        done += b - a
    assert done == len(texts)
    assert store.used <= 2 << 20 and 1000 < len(store.places) < (2 << 20) // units.OVERHEAD
    assert max(map(len, store.places)) <= units.LONGEST


def test_a_store_that_is_full_or_empty():
    import pyarrow as pa

    from tallybook.llm import units

    numbered = lambda some: units.Coded.of_lists([[ord(c) for c in u] for u in some])
    texts = [*texts_with_double_spaces(300), "", " ", "  ", "a", "a b", *["same words here"] * 50, "y" * 500]
    for limit in (0, 3000, 1 << 30):
        store = units.UnitStore(numbered, limit)
        for _ in range(2):
            got = []
            for _, _, ids, counts in units.encoded_texts(pa.array(texts), store, slice_bytes=500, piece_bytes=2000):
                ends = counts.cumsum()
                got += ["".join(map(chr, ids[e - c : e])) for e, c in zip(ends, counts)]
            assert got == texts
        assert store.used <= limit


def test_units_are_made_strings_in_one_go():
    from time import process_time

    import pyarrow as pa

    from tallybook.llm import units

    words = [f"w{i * 7919 % 1_000_003:x}" for i in range(100_000)] + ["é\x00", "w0"]
    text = " ".join(words)
    codes, per_text, found = units.split_units(pa.array([text]))
    assert [found[c] for c in codes] == [words[0], *(" " + w for w in words[1:])]
    assert per_text.tolist() == [len(words)] and all(type(u) is str for u in found)

    def least(work) -> float:
        def once() -> float:
            began = process_time()
            work()
            return process_time() - began

        return min(once() for _ in range(3))

    # Making a string of one Arrow scalar after the other takes longer than all the rest.
    assert least(lambda: units.split_units(pa.array([text]))) < least(pa.array(words).to_pylist)


ENDED = [
    *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "...", "!?!", ",%%%", "-----", "'s", "'s,", "),(", "\u2026", "\u3002", "\u0301.", "=\u0338",
    "<|endoftext|>", ".<|endoftext|>", "<|endoftext|>.", "\n.", ".\n", ".\nNext,", " .", "", "  ,", "\u00a0.", "1.", "\u00b2.", "\u0660,",
]
STEMS = ["word", "Été", "été", "à", "слово", "λόγος", "日本", "ひ", "e\u0301", "x1", "42", "\u00b2", "🎉", "\x00", "\u0600", "don't", "İ", "ß", "a\u00a0à", "-"]


def test_stems_and_endings_have_the_ids_of_their_units():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tallybook.llm import units

    path = tokenizer_path("byte_bpe_50k.json")
    draw = random.Random(5)
    letters = "".join(chr(c) for c in range(0x20, 0x530) if chr(c).isalpha())
    stems = STEMS + ["".join(draw.choices(draw.choice(["etaoin", "Ààéñß\u00e0\u0160", letters]), k=draw.randrange(1, 12))) for _ in range(3000)]
    texts = [s + e for s in STEMS for e in ENDED] + [f" {s}{e} {s}" for s in STEMS for e in ENDED]
    texts += [" ".join(draw.choice(stems) + (draw.choice(ENDED) if draw.random() < 0.4 else "") for _ in range(20)) for _ in range(2000)]
    for special_as_text in (False, True):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = special_as_text
        store = token_output._store.__wrapped__(path, special_as_text)
        for _ in range(2):
            for a, b, ids, counts in units.encoded_texts(pa.array(texts), store, piece_bytes=1 << 16):
                ends = counts.cumsum()
                for k in range(a, b):
                    want = library.encode(texts[k], add_special_tokens=False).ids
                    assert ids[ends[k - a] - counts[k - a] : ends[k - a]].tolist() == want, texts[k]


def test_a_word_is_tokenized_once_whatever_mark_it_ends_with():
    import pyarrow as pa

    from tallybook.llm import units

    store, asked = token_output._store.__wrapped__(tokenizer_path("byte_bpe_50k.json"), False), []
    encode = store.encode
    store.encode = lambda some: (asked.extend(some), encode(some))[1]
    marks = [",", ".", "!", "?", ";", ":", "...", '"', ")", "%"]
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)]
    text = " ".join(w + m for m in marks for w in words)
    assert sum(len(counts) for _, _, _, counts in units.encoded_texts(pa.array([text]), store)) == 1
    assert len(asked) <= len(words) + len(marks) + 1 and len(asked) == len(set(asked))


def test_distinct_units_of_a_store_come_from_arrow_as_they_are():
    import pyarrow as pa

    from tallybook.llm import units

    texts = pa.array(["", " ", "a", " lead", "a b  c d", "é b", "a\n b", "b a b"])
    codes, per_text, found = units.distinct_units(texts)
    plain = units.split_units(texts)
    assert isinstance(found, pa.StringArray) and found.to_pylist() == plain[2]
    assert (codes == plain[0]).all() and (per_text == plain[1]).all()
    ends = per_text.cumsum()
    got = ["".join(found[int(c)].as_py() for c in codes[e - n : e]) for e, n in zip(ends, per_text)]
    assert got == texts.to_pylist()
