from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from weftline.llm import decontaminate as D
from weftline.llm import language_id as L
from weftline.llm import simple8b as S
from weftline.llm import telephony as A
from weftline.llm import token_file as T
from weftline.llm.queries import byte_bpe

from .conftest import messy, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Benchmark decontamination


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for doc, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontaminate(spark, docs, empty):
    rows = [(r[0], r[1]) for r in messy()]
    items = [(1, " ".join(words(3, 60)[5:30])), (2, "One, two... THREE!"), (3, None), (4, ""), (5, " ".join(words(1, 120)[50:75])), (5, "é"), (10, " ".join(words(3, 60)[5:30])), (11, "ab" * 400), (12, "a " * 30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.decontaminate(docs, bench)
    assert set(got.columns) == set(docs.columns) | {"n_hit", "items", "contaminated"}
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items").collect()), key=str) == brute_hits(rows, items)
    assert D.decontaminate(empty, bench).count() == 0
    assert D.decontaminate(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_repeated_words(spark):
    rows, items = [(1, "a " * 25), (2, "b a " * 12 + "c"), (3, "x " * 9)], [("i", "a " * 12), ("j", "b a " * 7)]
    got = D.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items").collect()), key=str) == brute_hits(rows, items)


@pytest.mark.parametrize("most", [0, 200_000])
def test_benchmarks_of_any_size(spark, monkeypatch, most):
    """Windows and results that are too many to be broadcast, and a bitmap that lets nearly everything through."""
    monkeypatch.setattr(D, "MAX_BROADCAST", most)
    monkeypatch.setattr(D, "MAX_BITS", 1 << 10)
    text = words(50, 3000)
    rows = [(k, " ".join(text[k * 20 : k * 20 + 90])) for k in range(60)] * 2 + [(None, "clean " * 40)]
    items = [(f"i{k}", " ".join(text[k * 90 : k * 90 + 5 + k])) for k in range(30)] + [(None, " ".join(text[:12])), ("short", text[7]), ("two", " ".join(text[700:702]))]
    got = D.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"))
    want = [(d, n, h, [i for i in found if i != "None"]) for d, n, h, found in brute_hits(rows, items)]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items").collect()), key=str) == sorted(want, key=str)
    assert got.filter("contaminated <> (n_hit > 0)").count() == 0


# Language identification


def test_codewords():
    for n in (2, 3, 4, 6, 9):
        code = L.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2 + 1000 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else 4 if n < 7 else 2)


def test_language(spark, docs, empty):
    samples = {"en": "the cat and the house with this that of", "de": "der hund und das haus mit dem nicht ich", "fr": "le chien et la maison avec les où été"}
    rows = [(k, " ".join(np.random.default_rng(k).permutation(samples[lang].split())), lang) for k in range(120) for lang in samples]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.learn(train)
    assert model.labels == ["de", "en", "fr"]
    got = L.identify(train, model)
    assert got.filter("lang = lang_pred").count() == len(rows) and got.filter("score < 0 OR score > 1").count() == 0
    own = L.identify(docs, model)
    assert own.count() == docs.count() and {"lang_pred", "score", "ambiguous", "size"} <= set(own.columns)
    assert {r[0] for r in own.filter("lang_pred = 'und'").select("doc_id").collect()} == {5, 6, 7, 15, None}
    assert own.filter("lang_pred = 'und' AND score <> 0").count() == 0
    assert L.identify(empty, model).count() == 0
    again = L.learn(train.repartition(7))
    assert np.allclose(again.weights, model.weights)
    assert {r[0] for r in L.identify(train, L.learn(train.filter("lang = 'fr'"))).select("lang_pred").distinct().collect()} == {"fr"}
    assert {r[0] for r in L.identify(train, L.learn(train.filter("false"))).select("lang_pred").distinct().collect()} == {"und"}


def test_rare_labels_are_learned(spark):
    assert L.rooms({"a": 1000, "b": 3, "c": 500}, 100) == {"b": 3, "c": 48, "a": 49}
    assert L.rooms({"a": 5, "b": 3}, 100) == {"a": 5, "b": 3} and L.rooms({}, 100) == {}
    rows = [(f"the house of cats number {chr(97 + k % 26)} {k}", "en") for k in range(2000)] + [(f"perché gli zoccoli {chr(97 + k)}", "it") for k in range(6)]
    model = L.learn(spark.createDataFrame(rows, "text string, lang string"), max_fit=40)
    assert model.labels == ["en", "it"]


def test_more_labels_than_are_fitted(spark):
    """Any number of labels is accepted: those with most different texts are learned, ties by name, and texts are given one of them."""
    rows = [(f"word{chr(97 + k)} text{chr(97 + k)} {chr(97 + k) * 9} {j}", f"l{k:02d}") for k in range(24) for j in range(2 if k % 2 else 1)] + [("shared", "l00")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = L.learn(docs, max_fit=10)
    assert model.labels == ["l00", "l01", "l03", "l05", "l07", "l09", "l11", "l13", "l15", "l17"]
    assert {r[0] for r in L.identify(docs, model).select("lang_pred").distinct().collect()} <= set(model.labels)
    assert len(L.learn(docs, max_fit=100).labels) == 24


@pytest.mark.parametrize("n", [7, 40, 300])
def test_codewords_are_far_apart(n):
    code = L.codewords(n).astype(int)
    apart = (code[:, None, :] != code[None, :, :]).sum(2) + 1000 * np.eye(n, dtype=int)
    assert code.shape[0] == n and apart.min() >= 2




def test_language_of_many_copies_is_learned(spark):
    # 3000 rows of one language are copies of three texts: its threshold comes from the three, not from the rows.
    rows = [(f"the quick fox and that dog number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en") for i in range(300)]
    rows += [(f"le renard brun et les chiens de la maison {'abc'[i % 3]}", "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = L.learn(docs, max_fit=40)
    assert model.labels == ["en", "fr"]
    assert L.identify(docs, model).filter("lang_pred <> lang").count() == 0
    # Only copies: every label is there, and a label with little room among many texts too.
    assert L.learn(spark.createDataFrame([(t, la) for t, la in (("eins zwei", "de"), ("one two", "en")) for _ in range(5000)], "text string, lang string"), max_fit=10).labels == ["de", "en"]
    many = [(f"{name} text {i}", name) for name in (f"l{k:02d}" for k in range(40)) for i in range(120)]
    assert len(L.learn(spark.createDataFrame(many, "text string, lang string"), max_fit=80).labels) == 40


def features(*texts):
    return [L.counts_of(np.frombuffer(t, np.uint8)) for t in texts]


def test_long_text_is_read_whole(spark):
    model = L.fit(features(*[b"aaaa", b"bbbb"] * 10), ["a", "b"] * 10)
    (seen, share), = features(b"a" * 100 + b"b" * 4000)
    assert L.decode(model, (share @ model.weights[seen] + model.bias)[None])[0][0] == 1
    # So is what is learned from: the languages differ only after 10,000 bytes, and in slices of any size.
    rows = [("x" * 10_000 + t * (200 + k), la) for k in range(10) for t, la in (("der hund ", "de"), ("the cat ", "en"))]
    learned = L.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert L.identify(spark.createDataFrame(rows, "text string, lang string"), learned).filter("lang_pred <> lang").count() == 0


def test_features_by_brute_force(monkeypatch):
    """Counts of n-grams are those of a plain loop, and slices do not change them."""
    text = "Der Hund, 12 Ähren\tund\n\nthe CAT!".encode()
    lowered = [b + 32 if 65 <= b <= 90 else b for b in text]
    c = [b if 97 <= b <= 122 or b >= 128 else 0 for b in lowered]
    want: dict = {}
    for i in range(len(c)):
        one, two = c[i], c[i] + ((c[i - 1] << 8) if i else 0)
        three = two + ((c[i - 2] << 16) if i > 1 else 0)
        for code in (one, two + (1 << 24), three + (1 << 25)):
            slot = (code * 2654435761 % (1 << 32)) >> 19
            want[slot] = want.get(slot, 0) + 1
    for size in (1 << 20, 7):
        monkeypatch.setattr(L.K, "SLICE", size)
        (seen, share), = features(text)
        assert dict(zip(seen.tolist(), np.round(share**2 * len(text)).astype(int).tolist(), strict=True)) == want


def test_codes_by_brute_force():
    """Decoding is the codeword of least weighted loss, by a plain loop; untrusted bits count for nothing."""
    import math

    rng = np.random.default_rng(5)
    code = L.codewords(4)
    model = L.Model(["a", "b", "c", "d"], code, np.zeros((1, 7), np.float32), np.zeros(7, np.float32), rng.random(7).astype(np.float32))
    margins = rng.normal(size=(50, 7))
    best, score, gap = L.decode(model, margins)
    for m, k, s, g in zip(margins, best, score, gap, strict=True):
        loss = [sum(float(t) * math.log1p(math.exp(-x * c)) for t, x, c in zip(model.trust, m, word, strict=True)) for word in code]
        assert k == loss.index(min(loss)) and g == pytest.approx(sorted(loss)[1] - min(loss), abs=1e-5)
        assert s == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=1e-5)


def test_trust_comes_from_held_back_documents():
    """Labels without any relation to the texts: bits are right on what they learned and not on what was held back."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, 60).astype(np.uint8)) for _ in range(300)]
    model = L.fit(features(*texts), [f"l{k}" for k in rng.integers(0, 4, 300)])
    assert model.trust.max() < 0.5
    model = L.fit(features(*[b"aaa bbb", b"ccc ddd", b"eee fff"] * 20), ["x", "y", "z"] * 20)
    assert model.trust.min() == 1


def test_held_out_accuracy(spark):
    """The registered query on documents it has not learned from."""
    from weftline.llm.queries import op4_language_id

    got = op4_language_id(spark, "/root/testdata/sf0.01").filter("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    rows = got.filter("lang_pred <> 'und'").join(docs, "doc_id")
    assert rows.count() > 100 and rows.filter("lang = lang_pred").count() >= 0.98 * rows.count()


# Token ids


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_simple8b(n, high):
    ids = np.random.default_rng(n + high).integers(0, high + 1, n).astype(np.uint32)
    coded = S.encode(ids, 1000)
    assert (S.decode(coded) == ids).all()
    if n > 1000:
        assert (S.decode(coded, range(1, 2)) == ids[1000:2000]).all()


def test_simple8b_forms():
    for codes in ([0] * 200, [1 << 59], [1, 2, 3, 1 << 40, 0, 1], [(1 << b) - 1 for b in range(60)]):
        x = np.array(codes, np.uint64)
        assert (S.unpack(S.pack(x), len(x)) == x).all()
    with pytest.raises(ValueError):
        S.decode(b"nothing")


def test_tokens(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe())
    rows = [(r[0], r[1] or "") for r in messy()]
    want = sorted(((d, [*library.encode(t, add_special_tokens=False).ids, 2]) for d, t in rows), key=str)
    T.write_tokens(docs, str(tmp_path / "ids"), byte_bpe(), segment_ids=500)
    got = T.read_tokens(spark, str(tmp_path / "ids"), keep_ids=True).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"]) for r in got)
    T.write_tokens(empty, str(tmp_path / "none"), byte_bpe())
    assert T.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_encoder_equals_library():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from weftline.llm import kernels as K

    library, own, rng = Tokenizer.from_file(byte_bpe()), T.Encoder(byte_bpe(), max_cached=50), random.Random(4)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\r\n", "1", "42", ".", ",-", "|", "<|", "'", "'s", "don't", "世", " ", "\x1c", "×", "ǅ", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet[: rng.choice([16, 24])]) for _ in range(rng.randrange(30))) for _ in range(400)]
    data, offsets = K.text_bytes(pa.array(texts))
    ids, sizes = own.encode(data, offsets)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_tokenizer_files(tmp_path):
    """A file with another way to cut or clean texts is left to the library whole."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from weftline.llm import kernels as K

    plain = json.load(open(byte_bpe()))
    assert T.Encoder(byte_bpe()).by_pieces
    texts = ["Hello  World 12", "the CAT", "", "one two"]
    data, offsets = K.text_bytes(pa.array(texts))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**plain["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{**plain["added_tokens"][0], "content": "CAT"}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**plain, **change}))
        own, library = T.Encoder(str(path)), Tokenizer.from_file(str(path))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        ids, sizes = own.encode(data, offsets)
        assert not own.by_pieces and sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# Telephony audio


def test_tables():
    # Known codes of both laws: silence, the largest values, signs.
    assert A.mulaw_table()[[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124, 32124]
    assert A.alaw_table()[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def adpcm_by_sample(block):
    steps, index_step = A.step_table(), [-1, -1, -1, -1, 2, 4, 6, 8]
    predictor, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [predictor]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(steps[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            predictor = max(-32768, min(32767, predictor - change if nibble & 8 else predictor + change))
            index = max(0, min(88, index + index_step[nibble & 7]))
            out.append(predictor)
    return out


def test_adpcm():
    raw = np.random.default_rng(1).integers(0, 256, 36 * 20).astype(np.uint8).tobytes()
    want = [s for k in range(0, len(raw), 36) for s in adpcm_by_sample(raw[k : k + 36])]
    assert A.decode_adpcm(raw).tolist() == want
    assert A.read_adpcm(A.write_adpcm(raw)) == (raw, 36)
    with pytest.raises(ValueError):
        A.read_adpcm(A.write_adpcm(raw)[:-1])
    with pytest.raises(ValueError):
        A.read_au(A.write_au(raw)[:-1])


def test_resample():
    got = A.resample(np.array([0, 10, 21, 7, 8], np.int16), np.array([3, 5]))
    assert got.T.ravel().tolist() == [0, 5, 10, 15, 21, 21, 7, 7, 8, 8]


def test_pcm_is_lossless():
    """PCM that is not interpolated comes back as well; damage is noticed."""
    rng = np.random.default_rng(4)
    for factor in (1, 2, 3):
        phases, ends = rng.integers(-32768, 32768, (factor, 50)).astype(np.int16), np.array([7, 8, 50])
        stored = A.write_pcm(phases, ends)
        back, again = A.read_pcm(*map(list, zip(*stored, strict=True)))
        assert (back == phases).all() and (again == ends).all()
    with pytest.raises(ValueError):
        A.read_pcm([stored[0][0]], [stored[0][1][:-1]])


def plain_features(pcm):
    wide = [int(x) for x in pcm]
    turns = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
    return f"{len(wide)}:{sum(map(abs, wide))}:{sum(x * x for x in wide) // len(wide)}:{max(map(abs, wide))}:{turns}"


def test_audio(spark, docs, empty, tmp_path):
    """Media, PCM and features of every codec, from the stored files, against plain loops over samples."""
    A.write_audio(docs.select("doc_id", "text", "size", "n_chars"), str(tmp_path / "audio"))
    assert {"media", "pcm", "pcm_rest"} <= set(spark.read.parquet(str(tmp_path / "audio")).columns)
    got = A.read_stored(spark, str(tmp_path / "audio"), keep_pcm=True).collect()
    assert len(got) == docs.count() and "size" in got[0]
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_bytes"]), []).append(r)
    codecs = set()
    for doc, raw in sorted(((r[0], (r[1] or "").encode()) for r in messy()), key=str):
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = by[doc, len(raw)].pop()
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        codec = zlib.crc32(payload) % 3
        codecs.add(codec)
        media = A.write_adpcm(payload) if codec == 2 else A.write_au(payload, (A.MULAW, A.ALAW)[codec])
        assert (r["media_bytes"], r["media_sha256"], r["codec"]) == (len(media), hashlib.sha256(media).hexdigest(), A.CODECS[codec])
        if codec == 2:
            heard = [s for k in range(0, len(payload), 36) for s in adpcm_by_sample(payload[k : k + 36])]
        else:
            heard = [int((A.mulaw_table(), A.alaw_table())[codec][x]) for x in payload]
        pcm = [v for a, b in zip(heard, [*heard[1:], heard[-1]], strict=True) for v in (a, a + (b - a) // 2)]
        assert np.frombuffer(r["samples"], "<i2").tolist() == pcm and r["pcm_samples"] == len(pcm)
        assert r["feature"] == f"{A.CODECS[codec]}:{plain_features(pcm)}"
    assert codecs == {0, 1, 2}
    assert A.read_audio(A.store_audio(empty)).count() == 0
    assert A.read_audio(A.store_audio(docs.withColumn("media", docs.text).withColumn("Pcm", docs.text).withColumn("feature", docs.text))).count() == docs.count()
