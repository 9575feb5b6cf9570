"""Token counts, shards, packing and byte-level BPE against the public libraries."""

import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlog.llm import id_shards, packing, piece_bpe, token_fst
from fleetlog.llm.word_ids import WordEncoder
from fleetlog.session import new_run_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "  \n\n a", "\x1c a\x1d\x85b 　 c'sd's 'll", "日本語 \U0001f642\U0001f642 z", "ä ҉ İΣς",
    "x<|endoftext|>y <|startoftext|>", "'", "'r", "''s'' 're've it's 'rx 'lx '7 ''re", "e" * 3000 + "'ll", "12 \xb2\xbc a​b᠎c",
    "a" * 255 + " " + "b" * 255 + "'s", "".join(map(chr, range(0x500))), "".join(map(chr, range(0x2000, 0x3100))),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ids(rows, library):
    return [x.ids for x in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder(library):
    for limit in (5, 100_000):
        encode = WordEncoder(WORDS, limit)
        want = [x.ids for x in library.encode_batch(ODD, add_special_tokens=False)]
        assert [np.frombuffer(x, encode.dtype).tolist() for x in encode.encode(ODD)] == want


@pytest.fixture(scope="module")
def counter():
    return token_fst.Transducer(WORDS)


def test_transducer(counter, library):
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]
    assert counter.counts(ODD).tolist() == want
    assert [int(counter.counts([t])[0]) for t in ODD] == want


def test_transducer_with_a_small_table(library):
    small = token_fst.Transducer(WORDS, entries=40_000)
    assert small.counts(ODD).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_transducer_with_very_many_signs(library):
    """More different signs than the table holds, in one text and over several."""
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + 5000))), "".join(map(chr, range(0xAC00, 0xAC00 + 3000))), "plain", "".join(map(chr, range(0x5000, 0x5000 + 3000)))]
    count = token_fst.Transducer(WORDS)
    assert count.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count.width <= token_fst.MAX_SYMBOLS


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeilrstv'.,7 \né#")), max_size=5))
def test_transducer_on_any_text(counter, library, texts):
    if texts:
        assert counter.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_without_white_space(library):
    """States that pass through many chunks: words, one letter, a period that keeps its phase, digits, signs."""
    rng = np.random.default_rng(3)
    words = "".join(rng.choice(["the", "ing", "a", "trans", "ducer", "'s", "7", "#", "é", "qx"], 20_000))
    texts = [words, "a" * 5000, "ab" * 5001 + " x", "abc" * 3000 + "'", "=" * 7000, "1" * 3000, "x " + words[:3000], "日" * 2000]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    count = token_fst.Transducer(WORDS)
    assert count.counts(texts).tolist() == want
    assert [int(count.counts([t])[0]) for t in texts] == want


def test_maps_of_chunks_are_composed():
    """Pairs (chunk, state) as chunk << 32 | state; the chain from (1, 5) and what cannot be reached."""
    at = lambda chunk, state: chunk << 32 | state
    pairs = np.array([at(1, 0), at(1, 5), at(2, 0), at(2, 7), at(3, 0), at(3, 7), at(9, 2)])
    after = np.array([7, 7, 7, 0, 1, 1, 1])
    assert pairs[token_fst._composed(pairs, after, np.array([at(1, 5), at(9, 2)]))].tolist() == [at(1, 5), at(2, 7), at(3, 0), at(9, 2)]


def test_few_guesses(library, monkeypatch):
    monkeypatch.setattr(token_fst, "GUESSES", 1)
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdefgh"), 6000))
    assert token_fst.Transducer(WORDS).counts([text, "ab" * 2000]).tolist() == [
        len(library.encode(t, add_special_tokens=False).ids) for t in (text, "ab" * 2000)]


def test_count_tokens(docs, rows, ids, no_docs):
    found = token_fst.count_tokens(docs, WORDS, limit=100).collect()
    want = [(i, len((t or "").encode()), len(x), len(x) > 100) for (i, t), x in zip(rows, ids)]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert token_fst.count_tokens(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("part,change", [
    ("normalizer", lambda x: x.update(normalizer=None)),
    ("normalizer", lambda x: x["normalizer"]["normalizers"].pop()),
    ("pre_tokenizer", lambda x: x["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated")),
    ("pre_tokenizer", lambda x: x["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True)),
    ("model", lambda x: x["model"].update(ignore_merges=True)),
    ("model", lambda x: x["model"].update(end_of_word_suffix=None)),
    ("added_tokens", lambda x: x["added_tokens"][0].update(lstrip=True)),
    ("truncation", lambda x: x.update(truncation={"max_length": 5})),
    ("vocab", lambda x: x["model"]["vocab"].pop("a</w>")),
])
def test_other_settings_are_refused(spark, tmp_path, part, change):
    """Before any task runs."""
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    change(spec)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match=part):
        token_fst.count_tokens(spark.createDataFrame([], "doc_id long, text string"), str(path))
    assert token_fst.read_settings(WORDS)["version"]


def test_perfect_hash():
    for n in (0, 1, 2, 3, 10, 1000, 20_000):
        hashes = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        slots = id_shards.PerfectHash.build(hashes).slots(hashes)
        assert sorted(slots.tolist()) == list(range(n))


def test_shards(spark, docs, rows, ids):
    folder = new_run_dir(spark, "test-shards")
    id_shards.write_shards(docs, folder, WORDS, 2, shards=4)
    found = id_shards.read_shards(spark, folder).orderBy("start").collect()
    assert len(found) == len(rows)
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = sorted(str((i, len(x) + 1, crc([*x, 2]))) for (i, _), x in zip(rows, ids))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in found) == want
    wanted = spark.createDataFrame([(5,), (9,), (10**9,), (None,)], "doc_id long")
    by_key = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in id_shards.lookup(spark, folder, wanted).collect()}
    assert by_key == {rows[k][0]: [*ids[k], 2] for k in (5, 9)}


def test_empty_shards(spark, no_docs):
    folder = new_run_dir(spark, "test-shards")
    id_shards.write_shards(no_docs, folder, WORDS, 2)
    assert id_shards.read_shards(spark, folder).count() == 0


def unpack(pieces):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    filled = []
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        filled.append(end)
    return filled


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(docs, rows, ids, capacity):
    pieces = packing.pack(docs, WORDS, capacity, 2).collect()
    for end in unpack(pieces):
        assert end == capacity or end & (end - 1) == 0
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    once = [i for i, _ in rows if i and sum(j == i for j, _ in rows) == 1]
    for i in once:
        x, start = [*ids[i], 2], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (start, len(x), crc(x[start : start + p.length]))
            start += p.length
        assert start == len(x)


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, WORDS, 4096, 2).count() == 0


def test_level_is_the_best_one():
    """The chosen level gives the smallest sum of squares among all that are open."""
    rng = np.random.default_rng(1)
    packer = packing.Packer(30)
    for _ in range(400):
        n = int(rng.integers(1, 30))
        before = packer.level.copy()

        def total(h):
            after = before.copy()
            after[h] -= bool(h)
            after[h + n] += h + n < 30
            return int((after**2).sum())

        options = [h for h in range(30 - n + 1) if h == 0 or before[h] > 0]
        assert total(packer.choose(n)) == min(map(total, options))
        packer.add(1, np.zeros(n, "<u2"))


def test_few_open_windows():
    packer = packing.Packer(100, open_windows=4)
    for n in np.random.default_rng(2).integers(1, 100, 300):
        packer.add(1, np.zeros(int(n), "<u2"))
        assert packer.windows <= 4
    packer.empty()
    sizes = defaultdict(int)
    for row in packer.take():
        sizes[row[5]] += row[2]
    assert sorted(v for v in sizes.values() if v != 100) == sorted({v for v in sizes.values() if v != 100})


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=piece_bpe.read_ranks(BYTES), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.PieceBpe(BYTES, public_tokenizers.PATTERN, cache_parts=1000)


def test_byte_bpe_odd_texts(codec, reference):
    for text in ODD:
        found = codec.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(found) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_any_text(codec, reference, text):
    found = codec.encode(text)
    assert np.frombuffer(found, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(found) == text.encode()


def test_byte_bpe_frame(docs, rows, reference, no_docs):
    found = piece_bpe.encode_decode(docs, BYTES, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        x = reference.encode_ordinary(t or "")
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in found) == sorted(map(str, want))
    assert piece_bpe.encode_decode(no_docs, BYTES, public_tokenizers.PATTERN).count() == 0
