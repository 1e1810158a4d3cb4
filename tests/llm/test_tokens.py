"""Token ids: encoders against the tokenizers library, the token store, packing."""

import hashlib
import itertools
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyarrow import fs
from tokenizers import Tokenizer

from creditmill.llm import bpe_lexicon, packing, vocabulary, word_split
from creditmill.llm import tokens as token_ids
from creditmill.llm.bpe_lexicon import Lexicon, compile_words, coder, decode_documents, encode_documents, round_trip, thinned, to_file
from creditmill.llm.packing import Search, best_fit, least_bins, pack, packed_documents, pieces_of
from creditmill.llm.shingles import chunks
from creditmill.llm.token_store import EliasFano, Store, stored_tokens, write_store
from creditmill.llm.tokens import WORDS, encoder, splitter
from creditmill.llm.vocabulary import Vocabulary
from creditmill.llm.word_split import Words, added_pattern
from tests.llm.fixtures import documents, empty, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    signs = " \t\n\r'sdmtlrev.,!12é \x1c ßЖ́²😀_-\x00"
    fixed = ["", " \n\n b", "it's 's ''s x'll", "<|endoftext|>a <|endoftext|><|endoftext|>  b", "x" * 5000, "日本 ½ Ⅷ ٣", "ab" * 3000 + "  " * 50]
    return fixed + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(1500)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoders_equal_the_library(library, texts, tmp_path):
    want = [ids_of(library, t) for t in texts]
    assert [x.tolist() for x in encoder(PATH)(texts)] == want
    vocabulary = Vocabulary(PATH)
    words = sorted({w for t in texts[:800] for w in t.split() if w and "\0" not in w and len(w.encode()) <= 32})
    file = tmp_path / "lexicon.bin"
    file.write_bytes(to_file(compile_words([w.encode() for w in words], vocabulary.merge)))
    encode, _ = coder(PATH, str(file))
    assert [x.tolist() for x in encode(texts)] == want


def words_of(texts, added=None):
    found = []
    for _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        words = Words(data, offsets, added)
        own = words.bytes_of(np.arange(len(words.begin)))
        place, number, rows = words.distinct()
        assert [own[k] for k in place[number]] == own and len({own[k] for k in place}) == len(place)
        assert [r.tobytes()[: len(own[k])] for k, r in zip(place, rows, strict=True)] == [own[k][:32] for k in place]
        found += [[w.decode() for w in own[a:b]] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return found


def test_words_of_many_texts_equal_the_pattern(texts):
    split = splitter(PATH)
    rnd = random.Random(4)
    blanks = [" ", "  ", "\n", " \n", "\u00a0", "\u2003 ", "\u3000", "'", "'s", "'ll", "'re", "''d", "s", "v", "e", "l", "é", "1", "½", "日本", ".", "😀", "\u0301", "\x00"]
    more = ["".join(rnd.choice(blanks) for _ in range(rnd.randrange(12))) for _ in range(20_000)] + ["y" * 40 + " " + "y" * 41 + " " + "y" * 40, "\x00", "a\x00 a", None]
    assert words_of(texts + more, added_pattern(PATH)) == [split(t or "") for t in texts + more]
    assert words_of([]) == [] and words_of(["", None]) == [[], []]
    everything = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    assert words_of([everything]) == [regex.findall(WORDS, everything)]


def test_words_with_one_hash_are_told_apart(monkeypatch, texts):
    monkeypatch.setattr(word_split, "mixed", lambda x: x & np.uint64(3))
    words_of(texts[:300], added_pattern(PATH))


def test_invalid_text_is_an_error(tmp_path):
    file = tmp_path / "lexicon.bin"
    file.write_bytes(to_file(compile_words([], Vocabulary(PATH).merge)))
    broken = pa.array([b"a", b"b\xff\xe2"], pa.binary()).view(pa.string())
    with pytest.raises(pa.ArrowInvalid):
        list(coder(PATH, str(file))[0](broken))


def test_encoding_takes_less_time_than_the_pattern(tmp_path):
    rnd, split = random.Random(6), splitter(PATH)
    own = sorted({"".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)})
    texts = [" ".join(rnd.choices(own, k=400)) for _ in range(1000)]
    file = tmp_path / "lexicon.bin"
    file.write_bytes(to_file(compile_words([w.encode() for x in own for w in (x, " " + x)], Vocabulary(PATH).merge)))
    encode, _ = coder(PATH, str(file))
    taken = []
    for work in (lambda: list(encode(texts)), lambda: list(map(split, texts))):
        runs = []
        for _ in range(4):
            start = time.process_time()
            work()
            runs.append(time.process_time() - start)
        taken.append(min(runs))
    assert taken[0] < taken[1]


def test_spelling_of_many_texts(monkeypatch):
    monkeypatch.setattr(vocabulary, "IDS", 5)
    own = Vocabulary(PATH)
    ids, bounds = np.arange(300, 340), np.array([0, 0, 3, 20, 21, 40, 40])
    want = [b"".join(own.bytes_of[i] for i in ids[a:b].tolist()) for a, b in itertools.pairwise(bounds)]
    assert list(own.spelled()(ids, bounds)) == want
    assert list(own.spelled(lambda i: b"%d," % i)(ids, bounds)) == [b"".join(b"%d," % i for i in ids[a:b]) for a, b in itertools.pairwise(bounds)]


def test_decoder_equals_the_library(library):
    rnd, decode = random.Random(2), Vocabulary(PATH).decoder()
    for _ in range(300):  # most of these are no whole characters
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(12))]
        assert decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact(tmp_path):
    words = [w.encode() for w in ("", "tap", "taps", "top", "tops", "stop", "stops", "a", "é")]
    ranks = sorted(set(words))
    arrays = compile_words(words, lambda some: [np.array([i, 7], np.uint32).tobytes() for i, _ in enumerate(some)])
    file = tmp_path / "words.bin"
    file.write_bytes(to_file(arrays))
    lexicon = Lexicon(str(file))
    asked = [*ranks[1:], b"ta", b"sto", b"stopss", b"b", b"x" * 40]
    assert lexicon.ranks(asked).tolist() == [*range(1, len(ranks)), -1, -1, -1, -1, -1]

    def states(suffixes):  # distinct right languages, counted the plain way
        every = {frozenset(w[k:] for w in suffixes if w[:k] == p) for s in suffixes for k in range(len(s) + 1) for p in [s[:k]]}
        return len(every)

    assert len(arrays["final"]) == states(set(words))


def test_summaries_keep_heavy_words():
    counts = bpe_lexicon.Counter({f"w{i}": 1 for i in range(1000)} | {"heavy": 500, "second": 300})
    left = thinned(counts, 10)
    assert len(left) <= 10 and left["heavy"] >= 499 and left["second"] >= 299


def test_round_trip_of_odd_rows(spark, library):
    rows = odd_texts()
    got = sorted(map(tuple, round_trip(documents(spark, rows), PATH).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = ids_of(library, t)
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), listed, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert round_trip(empty(spark), PATH).collect() == []


def test_encode_then_decode(spark):
    docs = documents(spark, odd_texts())
    lexicon = bpe_lexicon.compiled_lexicon(docs, PATH, 50)
    back = decode_documents(encode_documents(docs, PATH, lexicon), PATH)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in odd_texts()), key=repr)


@pytest.mark.parametrize("values", [[], [5], [-3, -3, 0, 7], [0] * 600, list(range(0, 10**9, 999_983)), [0, 1, 10**12]])
def test_elias_fano(values):
    data = EliasFano.of(np.array(values, np.int64))
    sequence = EliasFano(data)
    assert sequence.values().tolist() == values
    assert [sequence.select(i) for i in range(len(values))] == values
    assert sequence.values(1, 3).tolist() == values[1:3]


def test_elias_fano_is_near_the_least_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert 8 * len(EliasFano.of(values)) / len(values) < 2.6 + np.log2(1000)


def test_token_store(spark, library):
    rows = odd_texts()
    got = sorted(stored_tokens(documents(spark, rows), PATH).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    assert [r.doc_id for r in got][2:] == sorted(i for i, _ in rows if i is not None) and got[0].doc_id is None
    place, by_id = 0, defaultdict(list)
    for i, t in rows:
        ids = [*ids_of(library, t), 2]
        by_id[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == place and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        place += r.n_tokens
    assert stored_tokens(empty(spark), PATH).collect() == []


def test_single_documents_of_a_file(spark, library):
    listed = write_store(documents(spark, odd_texts()), PATH).collect()
    seen = 0
    for row in listed:
        with Store(row["file"]) as store:
            names = [i for own, _ in store.blocks() for i in own]
            for k, i in enumerate(names):
                assert store.document(k)[-1] == 2
                assert i is None or store.document(k)[:-1].tolist() in [ids_of(library, t) for j, t in odd_texts() if j == i]
            seen += len(names)
    assert seen == len(odd_texts())
    files, place = fs.FileSystem.from_uri(listed[0]["file"])
    with files.open_output_stream(place + ".cut") as out:
        out.write(files.open_input_file(place).read(40))
    with pytest.raises(ValueError):
        Store(listed[0]["file"] + ".cut")


def test_pieces():
    assert pieces_of(5, 8) == [(0, 5)] and pieces_of(8, 8) == [(0, 8)]
    assert pieces_of(17, 8) == [(0, 1), (1, 8), (9, 8)] and pieces_of(16, 8) == [(0, 8), (8, 8)]


def check_packing(rows, lengths, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= size
    for i, n in lengths.items():
        assert [(r.start, r.length) for r in sorted(by_doc[i], key=lambda r: r.piece)] == pieces_of(n, size)
    return len(by_sequence)


def test_packed_documents(spark, library, monkeypatch):
    rows = [(k, t) for k, (_, t) in enumerate(odd_texts())]
    lengths = {i: len(ids_of(library, t)) + 1 for i, t in rows}
    for group in (20_000, 4):
        monkeypatch.setattr(packing, "GROUP", group)
        got = packed_documents(documents(spark, rows), PATH, size=256).collect()
        n = check_packing(got, lengths, 256)
        assert n <= -(-sum(lengths.values()) // 256) + (1 if group > 4 else 4)
    for r in got:
        ids = [*ids_of(library, dict(rows)[r.doc_id]), 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packed_documents(empty(spark), PATH).collect() == []
    copies = packed_documents(documents(spark, [(7, "same")] * 50 + [(None, "same")]), PATH, size=8).collect()
    assert len(copies) == 51 and all(r.length == copies[0].length for r in copies)


def test_search_improves_best_fit():
    rnd, better = random.Random(4), 0
    for trial in range(120):
        size = 200
        low, high = (50, 110) if trial % 2 else (1, 200)
        lengths = [rnd.randrange(low, high) for _ in range(60 if trial % 2 else rnd.randrange(1, 60))]
        start, end = best_fit(lengths, size), pack(lengths, size)
        assert sorted(i for b in end for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= size for b in end)
        assert least_bins(lengths, size) <= len(end) <= len(start)
        better += len(end) < len(start)
    assert better
    # one swap away from three full bins
    assert len(pack([7, 6, 3, 4, 5, 5], 10)) == 3


def steps_left(lengths, bins, size):
    """Every exchange of up to two pieces for up to two (not two for two) that fits and adds to the squared fills."""
    takes = lambda b, most: [c for k in range(most + 1) for c in itertools.combinations(b, k)]
    fill = [sum(lengths[i] for i in b) for b in bins]
    for s, t in itertools.permutations(range(len(bins)), 2):
        if not (fill[s] < size and fill[t] < size):
            continue
        for out in takes(bins[s], 2)[1:]:
            for back in takes(bins[t], 2 if len(out) == 1 else 1):
                d = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                if 0 < d <= size - fill[t] and (fill[s] - d) ** 2 + (fill[t] + d) ** 2 > fill[s] ** 2 + fill[t] ** 2:
                    return out, back
    return None


def test_no_step_is_left():
    rnd, searched = random.Random(11), 0
    for trial in range(150):
        size = rnd.choice([30, 100, 300])
        low, high = [(1, size), (size // 4, size // 2 + 1), (1, size // 4), (size // 3, 2 * size // 3)][trial % 4]
        lengths = [rnd.randrange(low, high) for _ in range(rnd.randrange(2, 40))]
        bins = pack(lengths, size)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= size for b in bins)
        if len(bins) > least_bins(lengths, size):
            searched += 1
            assert steps_left(lengths, bins, size) is None
    assert searched > 20


def test_bins_of_many_pieces_give_all_their_pairs():
    # 60 different lengths in a bin: the last pair of them fills the other one.
    lengths = [*range(1, 61), 1990 - 60 - 59]
    search = Search(lengths, [list(range(60)), [60]], 1990)
    assert search.step(1) >= 0 or search.step(0) >= 0
    assert max(search.fill) == 1990


def fewest(lengths, size):
    """The least number of bins, by trying all places for every piece."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[k]:
                place(k + 1, (*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]))
        place(k + 1, (*rooms, size - lengths[k]))

    place(0, ())
    return best


def test_against_exhaustive_packing():
    rnd, same, trials = random.Random(7), 0, 300
    for _ in range(trials):
        size = rnd.choice([12, 50, 100])
        lengths = [rnd.randrange(1, size) for _ in range(rnd.randrange(1, 9))]
        best = fewest(lengths, size)
        got = len(pack(lengths, size))
        assert least_bins(lengths, size) <= best <= got <= best + 1
        same += got == best
    assert same >= 0.99 * trials


@pytest.mark.parametrize("run", [0, 3, 5_000])
def test_whole_texts_and_words_give_the_same_ids(library, monkeypatch, run):
    monkeypatch.setattr(token_ids, "RUN", run)
    rnd = random.Random(run)
    letters = "  \n\t\r\x0b\x1c\x85　 'stdmvl'ABz09é中!?_́‍\U0001f600"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(2000)]
    texts += ["", "<|endoftext|>", "x <|endoftext|> y", " " * 5001 + "a", "b" * 6000, "中" * 2000, "\n" * 5000 + " x"]
    got = list(token_ids.encoder(PATH)(texts))
    assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_longest_run():
    assert [token_ids.longest_run(x) for x in (b"", b"a", b"ab  c", b"a   ", b" \n\tab", b"abcd")] == [0, 1, 2, 3, 3, 4]
