import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tests.llm.helpers import DOCS, frame, rows, words

from leadlens.llm import ann, audio, components, html_text, minhash, packing, pii, sharding, spiece, suffix, toxicity
from leadlens.llm.queries import vocabulary

DATA = rows()


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_components(data, k, share):
    sets = {}
    for i, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, DATA), words=k).collect()}
    assert got == brute_components(DATA, k, 80)


def test_near_duplicates_large_group(spark, monkeypatch):
    """A group over several chunks, with members whose only links lie across chunks."""
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 8)
    monkeypatch.setattr(minhash, "NODE_ROWS", 16)
    rng = random.Random(3)
    base = words(rng, 60).split(" ")
    data = []
    for i in range(70):
        w = list(base)
        for j in rng.sample(range(60), rng.choice([2, 4, 9])):
            w[j] = f"z{rng.randint(0, 9)}"
        data.append((i, " ".join(w), *DATA[0][2:]))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, data), words=1).collect()}
    assert got == brute_components(data, 1, 80)


def test_near_duplicates_edges(spark):
    data = [(None, "no id", *DATA[0][2:]), (5, "same words here", *DATA[0][2:]), (5, "same words here", *DATA[0][2:]), (4, "same words here", *DATA[0][2:])]
    got = [tuple(r) for r in minhash.near_duplicates(frame(spark, data), words=2).orderBy("doc_id").collect()]
    assert got == [(4, 2, 4, True), (5, 2, 4, False)]
    assert minhash.near_duplicates(frame(spark, []), words=2).count() == 0


def test_near_duplicates_repeated_ids(spark):
    """Of rows that repeat an id one text counts, so that they don't bridge groups."""
    a, b = words(random.Random(1), 30), words(random.Random(2), 30)
    docs = frame(spark, [(i, t, *DATA[0][2:]) for i, t in ((1, a), (1, b), (2, b), (3, a))])
    first = docs.where("doc_id = 1").orderBy(minhash.text_rank()).first().text
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got == ({1: 1, 2: 2, 3: 1} if first == a else {1: 1, 2: 1, 3: 3})


def test_link_forest_compares_all_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(60)] + [np.zeros(0, np.uint64)]
    near = {(i, j) for i in range(61) for j in range(i) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    forest = minhash.link_forest(sets, 50)
    assert all((max(i, j), min(i, j)) in near for i, j in forest)
    low = [i for i in range(61)]
    for _ in range(61):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    stars = minhash.star(np.arange(61), *np.array(forest).T)
    assert sorted(zip(*(x.tolist() for x in stars), strict=True)) == sorted((m, i) for i, m in enumerate(low) if m != i)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 8), (None, 4), (20, 21), (21, 22), (22, 23), (23, 24), (3, 1)], "a long, b long")
    assert {(r.id, r.label) for r in components.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (20, 20), (21, 20), (22, 20), (23, 20), (24, 20)}
    assert components.components(links.limit(0)).count() == 0


def test_best_fit_is_tight():
    sizes = np.array([60, 40, 50, 50, 70, 30, 10, 90])
    bins, offsets, n = packing.best_fit(sizes, 100)
    assert n == 4
    for k in range(n):
        own = sorted(zip(offsets[bins == k], sizes[bins == k], strict=True))
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([s for _, s in own])[:-1]]).tolist() and sum(s for _, s in own) <= 100


def check_packed(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    data = [*DATA, (None, "no id", *DATA[0][2:]), (900, "ΟΔΟΣ Σίγμα, ok. it's odd!!", *DATA[0][2:]), (901, "<|endoftext|> a", *DATA[0][2:]), (902, "a \u0130\u302d word \u0130stanbul", *DATA[0][2:])]
    got = packing.best_fit_pack(frame(spark, data), vocabulary("word_bpe_49k.json"), capacity=256).collect()
    want = []
    for i, x, *_ in data:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            raw = np.array(ids[k : k + 256], "<u4").tobytes()
            want.append((i, k // 256, k, len(raw) // 4, zlib.crc32(raw)))
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert check_packed(got, 256) <= 1.05 * sum(r.length for r in got) / 256 + 2
    assert packing.best_fit_pack(frame(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 20)
    rng = random.Random(2)
    pieces = spark.createDataFrame([(i, 0, rng.randint(1, 60)) for i in range(400)], "doc_id long, piece int, length long")
    got = packing.packed(pieces, 100).collect()
    assert len(got) == 400 and check_packed(got, 100) <= 1.1 * sum(r.length for r in got) / 100 + 1


def test_packing_of_pieces_that_do_not_pair(spark, monkeypatch):
    """No task gets more bins than a group has, though hardly any two go together; rounds end."""
    monkeypatch.setattr(packing, "GROUP_ITEMS", 20)
    pieces = spark.createDataFrame([(i, 0, 51 if i % 50 else 40) for i in range(600)], "doc_id long, piece int, length long")
    got = packing.packed(pieces, 100).collect()
    assert len(got) == 600 and check_packed(got, 100) <= 600
    assert max(r.sequence_id & (1 << 28) - 1 for r in got) < 60  # a task numbers its bins from 0


def test_audio(spark):
    data = [*DATA, (None, "y" * 576, *DATA[0][2:])]
    got = audio.digests(frame(spark, data)).collect()
    stored = {(r.doc_id, bytes(r.payload)): bytes(r.media) for r in audio.store_texts(frame(spark, data)).collect()}
    assert len(got) == len(data)
    for r in got:
        text = next(t or "" for i, t, *_ in data if i == r.doc_id).encode()
        payload = text + b"\xff" * (-len(text) % 576 or (576 if not text else 0))
        media = stored[r.doc_id, payload]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and audio.unriff(media) == ("mulaw", 8000, payload)


def test_audio_codecs(spark):
    assert audio.MULAW[255] == 0 and audio.MULAW[0] == -32124 and audio.MULAW[128] == 32124 and audio.ALAW[0xD5] == 8 and audio.ALAW[0x55] == -8 and audio.ALAW[0x2A] == -32256
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 256, (7, audio.ADPCM_BLOCK), dtype=np.uint8)

    def slow(block):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        out = [value]
        for b in block[4:].tolist():
            for code in (b & 15, b >> 4):
                step = int(audio.STEPS[index])
                diff = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + int(audio.MOVES[code & 7])))
                out.append(value)
        return out

    assert audio.decode_adpcm(blocks).tolist() == [slow(b) for b in blocks]
    media = [audio.riff(blocks.tobytes(), "ima"), audio.riff(b"\x10\x20\x30", "alaw"), b"junk", None]
    got = audio.decode_media(spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in enumerate(media)], "id int, media binary")).orderBy("id").collect()
    assert [r.pcm_rate for r in got] == [16000, 16000, None, None] and [len(audio.unriff(bytes(r.pcm))[2]) for r in got[:2]] == [4 * blocks.shape[0] * 377, 12]


def test_resampling(spark):
    pcm = np.array([0, 100, -50, 7], np.int16)
    assert audio.resampled(pcm, 8000, 16000).tolist() == audio.doubled(pcm).tolist() == [0, 50, 100, 25, -50, -22, 7, 7]
    assert audio.resampled(pcm, 8000, 8000) is pcm and audio.resampled(pcm, 8000, 4000).tolist() == [0, -50]
    for have, want in ((8000, 11025), (11025, 8000), (16000, 48000)):
        at = np.arange(-(-len(pcm) * want // have)) * have / want
        exact = np.interp(at, np.arange(len(pcm)), pcm)
        assert np.abs(audio.resampled(pcm, have, want) - exact).max() <= 1
    named = spark.createDataFrame([(bytearray(audio.riff(b"\x10" * 9, "mulaw", 11025)), 1, "x")], "media binary, pcm int, pcm_rate string")
    row = audio.decode_media(named, rate=8000).first()
    assert row.pcm_rate == 8000 and audio.unriff(bytes(row.pcm))[:2] == ("pcm", 8000)
    stored = audio.store_texts(frame(spark, [(1, "abc", *DATA[0][2:])])).first()
    assert audio.unriff(bytes(stored.pcm)) == ("pcm", 16000, audio.resampled(audio.MULAW[np.frombuffer(bytes(stored.payload), np.uint8)], 8000, 16000).astype("<i2").tobytes())


def brute_spans(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[1])))


def test_pii_base_spans():
    rng = random.Random(7)
    parts = ["a", "b.", "@", ".", "1", "22", "333", "+", "-", " ", "é", "(", "4111111111111111", "9.9.9.9", "x@y.z", "+1 (555) 123-4567", "0" * 30]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii(spark):
    hexes = [hashlib.sha1(bytes([i])).hexdigest() for i in range(60)]
    data = [(i, f'é of and token = "{h}" by a@b.co {"" if i % 3 else "+1 (017) 555-7713"}', *DATA[0][2:]) for i, h in enumerate(hexes)] + [(100, None, *DATA[0][2:]), (None, "", *DATA[0][2:]), (101, "Clean words Here only 1234567890123456", *DATA[0][2:])]
    got = {r.doc_id: r for r in pii.find_spans(frame(spark, data)).collect()}
    for i, t, *_ in data:
        base = brute_spans(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in pii.BASE_KINDS]
        secret = [] if not t or "token" not in t else [(t.index('"') + 1, "secret", t.rindex('"'))]
        assert r.spans == pii.written(sorted(base + secret))
    masked = {r.doc_id: r.text for r in pii.mask_spans(frame(spark, data)).collect()}
    assert masked[1] == 'é of and token = "[SECRET]" by [EMAIL] ' and masked[100] is None and masked[101] == data[-1][1]
    assert pii.find_spans(frame(spark, [])).count() == 0


def test_sentencepiece(spark):
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    sp, pieces = SentencePieceProcessor(model_file=path), spiece.Pieces.load(path)
    hard = ["a  b\nc\t dé ☃ foo", "    x", "ﬁx", "a\x00b", "  ", "hello " * 5, "x" * 300, "▁a", "1234567 aaaa\n\n\nbb", "日本語テキスト", "<s>a</s> <0x0A>", words(random.Random(4), 300)]
    data = [(i, t, *DATA[0][2:]) for i, t in enumerate(hard)] + [(50, None, *DATA[0][2:]), (51, "", *DATA[0][2:]), (0, hard[0], *DATA[0][2:])]
    got = spiece.encode(frame(spark, data), path).collect()
    assert len(got) == len(data) and all(r.ids == sp.encode(data[r.doc_id][1] if r.doc_id < 50 else "") for r in got)
    digest = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in spiece.encode(frame(spark, data), path, as_ids=False).collect()}
    assert all(digest[r.doc_id] == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    decoded = spiece.decode(spiece.encode(frame(spark, data), path), spark, path).collect()
    back = {r.doc_id: r.text for r in decoded}
    assert len(decoded) == len(data) and all(back[i] == (t or "").replace("▁", " ") for i, t, *_ in data)
    lattice = spiece.lattice_ids(spark.createDataFrame([(w,) for t in hard for w in set(pieces.split(t)) if len(w) <= spiece.LONGEST], "word string").distinct(), path).collect()
    assert all(np.array(r.ids, "<u4").tobytes() == pieces.ids(r.word) for r in lattice)
    assert spiece.encode(frame(spark, []), path).count() == 0


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 9)
    data = [*DATA, (None, "no id", *DATA[0][2:]), DATA[3]]
    got = sharding.shard_documents(frame(spark, data)).collect()
    texts = {i: t or "" for i, t, *_ in data}
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    by_text, by_shard = {}, {}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
        by_shard.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(1)
    loads = np.zeros((500, 8), np.int64)
    loads[:, 0] = rng.integers(1, 1000, 500)
    place = sharding.differenced(loads)
    total = np.zeros(8, np.int64)
    np.add.at(total, place, loads)
    assert total.sum() == loads.sum() and total.max() - total.min() <= 3
    assert (np.sort(place, axis=1) == np.arange(8)).all()


def test_embeddings_repeated_ids(spark):
    """Rows that repeat an id are vectors of their own."""
    v1, v2 = [1.0, 0.0], [0.0, 1.0]
    data = [(1, v1, 3), (1, v2, 9), (2, v2, 3), (3, v1, 3), (4, v2, 9), (1, v1, 3)]
    got = sorted(map(tuple, ann.near_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 1, 1, False)]


def test_table_keys_grow():
    assert ann.key_bits(1000) == 16 and ann.rotations(16) == 4 and ann.key_bits(1 << 26) == 22
    for bits in (16, 19, 22, 32):
        tables = ann.rotations(bits) * (ann.BITS // bits)
        assert (1 - (1 - ann.BIT_DIFFERS) ** bits) ** tables <= ann.MISSED * 1.2
    x = np.random.default_rng(1).standard_normal((50, 8))
    assert ann.Quantiser(x, 19)(x).shape == (50, ann.Quantiser(x, 19).tables) and ann.Quantiser(x, 19)(x).max() < 1 << 19


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 64))
    data = []
    for i in range(300):
        data.append((i, (centres[i % 12] + rng.standard_normal(64) * rng.choice([0.01, 0.1, 2])).astype(np.float32).tolist(), int(rng.integers(0, 2)) if i % 50 else None))
    data += [(300, data[1][1], data[1][2]), (301, [0.0] * 64, 0), (302, None, 0), (303, [float("nan")] * 64, 0), (304, [], 0), (305, [None] * 64, 0), (306, [2 * x for x in data[1][1]], data[1][2]), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ann.near_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    sound = {i: np.array(v, float) for i, v, b in data if v and b is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: b for i, _, b in data}
    links = {i: {j for j in sound if i != j and i in sound and label[i] == label[j] and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= 0.98} for i, *_ in data}
    low = {i: i for i in links}
    for _ in range(len(low)):
        new = {i: min([low[i], *(low[j] for j in links[i])]) for i in low}
        if new == low:
            break
        low = new
    want = sum(map(len, links.values()))
    found = sum(n for n, *_ in got.values())
    assert got.keys() == links.keys() and found <= want and found >= 0.98 * want and all(got[i][0] <= len(links[i]) for i in links)
    assert sum(got[i][1] == low[i] for i in low) >= 0.98 * len(low)
    assert ann.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_repeats(data):
    seen, out = set(), {}
    for i, t, *_ in sorted(data, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        own = {b[j : j + 50] for j in range(len(b) - 49)}
        for j in range(len(b) - 49):
            if b[j : j + 50] in seen:
                gone[j : j + 50] = True
        seen |= own
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0])), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, monkeypatch, small):
    if small:
        for name, v in (("BLOCK_BYTES", 3000), ("BUCKET_ENTRIES", 50), ("SHARD_BYTES", 300)):
            monkeypatch.setattr(suffix, name, v)
    data = DATA + [(500 + i, t[0], *DATA[0][2:]) for i, t in enumerate([("ab" * 200,), ("ab" * 180 + "c",), ("b" + "ab" * 100,), ("é" * 60,)])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(frame(spark, data)).collect()}
    assert got == brute_repeats(data)


def test_suffix_edges(spark):
    same = "the very same text in two rows of one and the same document id, repeated"
    data = [(None, same, *DATA[0][2:]), (1, same, *DATA[0][2:]), (1, same, *DATA[0][2:]), (2, None, *DATA[0][2:])]
    assert sorted(r.n_removed for r in suffix.remove_repeats(frame(spark, data)).collect()) == [0, 0, 0]
    got = suffix.without_repeats(frame(spark, data))
    assert got.columns == frame(spark, data).columns and sorted(map(str, (r.text for r in got.collect()))) == sorted(["None", same, same, same])
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for lane in (1, 3, 64):
        raw = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 300))) + suffix.SEPARATOR
        data = np.frombuffer(raw, np.uint8)
        order, rank = suffix.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:]) and order[rank].tolist() == list(range(len(raw)))
        common = suffix.common_prefixes(data, order, lane)
        for k in range(1, len(order)):
            a, b = raw[order[k] :], raw[order[k - 1] :]
            assert common[k] == next((j for j in range(len(a)) if a[j : j + 1] != b[j : j + 1]), len(a))


@pytest.mark.parametrize("shard", [1 << 20, 150])
def test_shared_windows(monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab\x00") for _ in range(200))
    for _ in range(40):
        cuts = [(rng.randint(0, 100), rng.randint(50, 90)) for _ in range(rng.randint(1, 12))]
        snippets = [base[a : a + n] if rng.random() < 0.5 else base[a : a + n // 2] + b"c" + base[a + n // 2 + 1 : a + n] for a, n in cuts]
        owner = [rng.randint(0, 5) for _ in snippets]
        least = {}
        for x, o in zip(snippets, owner, strict=True):
            for i in range(len(x) - 49):
                least[x[i : i + 50]] = min(o, least.get(x[i : i + 50], o))
        want = [[least[x[i : i + 50]] < o for i in range(len(x) - 49)] for x, o in zip(snippets, owner, strict=True)]
        assert [c.tolist() for c in suffix.shared_windows(snippets, np.array(owner))] == want


def test_frequent_anchors_over_tasks(spark, monkeypatch):
    """One passage with something else around it in every document: its anchors are dealt to several tasks."""
    monkeypatch.setattr(suffix, "SHARD_BYTES", 400)
    rng = random.Random(4)
    passage = "the one passage of thirty bytes"
    data = [(i, f"{words(rng, 4)} {passage} {words(rng, 3)} {'again and again the same words follow here, and more of them' if i % 3 else ''}", *DATA[0][2:]) for i in range(200)]
    docs = frame(spark, data)
    deal = suffix.Deal(4, *suffix._frequent(docs.selectExpr("doc_id", "cast(text as binary) as text"), 1000))
    assert len(deal.frequent) and deal.parts.min() > 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert got == brute_repeats(data)


def test_frequent_anchors_make_no_job_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_frequent", lambda docs, size: (np.array([7], np.uint64), np.array([2])))
    assert "LogicalRDD" not in suffix.remove_repeats(spark.range(3).selectExpr("id as doc_id", "repeat(cast(id as string), 60) as text"))._jdf.queryExecution().optimizedPlan().toString()
    ids = np.array([-(1 << 63), -5, 0, 3, (1 << 63) - 1])
    assert (suffix._unpacked(suffix._packed(ids, 8), 8).view(np.int64) == ids).all() and not len(suffix._unpacked(b"", 6))


def test_without_repeats_keeps_columns(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    data = [(i, x, day, True, {"a": i}, "row") for i, x in ((1, "p" * 60), (2, "q" + "p" * 60), (3, None), (None, "p" * 60))]
    docs = spark.createDataFrame(data, "doc_id long, text string, at timestamp_ntz, _null boolean, `a.b` map<string, int>, row string")
    got = suffix.without_repeats(docs)
    assert got.schema == docs.schema
    want = {(1, "p" * 60), (2, "q"), (3, None), (None, "p" * 60)}
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == want and all((r.at, r["_null"], r.row) == (day, True, "row") for r in rows)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "SLICE_BYTES", 40)
    monkeypatch.setattr("leadlens.llm.common.SLICE_BYTES", 40)
    rng = random.Random(9)
    texts = [words(rng, n).encode() for n in (0, 60, 3, 0, 200)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    from leadlens.llm import common

    h, d = common.word_hashes(data, offsets)
    h1, d1 = common.word_hashes_of(data, offsets)
    assert h.tolist() == h1.tolist() and d.tolist() == d1.tolist()
    r = suffix.runs(data, offsets)
    windows = [(i, offsets[i] + k) for i, t in enumerate(texts) for k in range(len(t) - suffix.LENGTH + 1)]
    assert [(i, w) for i, a, b in zip(r["doc"].tolist(), r["first"].tolist(), r["last"].tolist(), strict=True) for w in range(a, b + 1)] == windows


def test_sentencepiece_query_decodes(spark, tmp_path):
    from leadlens.llm import queries

    data = [*DATA, (900, " two  blanks \u2603 \n end ", *DATA[0][2:]), (None, "no id", *DATA[0][2:])]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.decoded) for r in got) == sorted((i is None, i, t or "") for i, t, *_ in data)
    assert all(len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    same = spiece.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), spark, queries.vocabulary("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.text) for r in same) == sorted((str(r.doc_id), r.decoded) for r in got)


def test_viterbi_takes_the_best_path(spark):
    rng = random.Random(5)
    table = {w: -float(rng.randint(1, 40)) for w in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)}}
    words_ = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)}

    def best(w):
        if not w:
            return 0.0, ()
        paths = [(s + table[w[i:]], (*p, w[i:])) for i in range(max(0, len(w) - 4), len(w)) if w[i:] in table and (s := best(w[:i])[0]) is not None for p in [best(w[:i])[1]]]
        return max(paths, key=lambda x: (x[0], len(x[1][-1]))) if paths else (None, None)

    got = spiece.viterbi_pieces(spark.createDataFrame([(w,) for w in words_], "word string"), spark.createDataFrame(list(table.items()), "piece string, score double"), 4).collect()
    assert len(got) == len(words_)
    for r in got:
        total, path = best(r.word)
        assert (r.pieces is None) == (path is None) and (path is None or ("".join(r.pieces) == r.word and sum(table[p] for p in r.pieces) == total))


def test_frequent_words_over_limit(spark):
    from leadlens.llm.queries import vocabulary

    path, text = vocabulary("piece_bpe_32k.model"), "one two three four " * 1100
    assert spiece.frequent_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, limit=2).count() == 0


def toxic_data(n=400):
    rng, docs, labels = random.Random(6), [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        w = words(rng, 40).split(" ")
        if toxic:
            w[7], w[20] = rng.choice(["blockhead", "nitwits"]), rng.choice(["blockhead", "nitwits", "blokhead"])
        docs.append((i, " ".join(w), *DATA[0][2:]))
        labels.append((i, 1, toxic))
    return docs, labels


def test_rare_terms_of_few_toxic_documents(spark):
    """Where toxic documents are rare, a term that two of them have and no clean one says enough."""
    docs = [(i, f"plain words {i} of document" + (" gruntlewort" if i in (3, 6) else " snarlebeck" if i < 8 else ""), *DATA[0][2:]) for i in range(2000)]
    labels = spark.createDataFrame([(i, 1, int(i < 8)) for i in range(2000)], "doc_id long, quality int, toxic int")
    usable = [i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert {3, 6} <= set(usable) and toxicity.g_squared(2, 0, len(usable), 1500) > toxicity.LEAST_G2
    terms = toxicity.fit(frame(spark, docs), labels).terms
    assert any("gruntlewort".startswith(t) for t in terms)


def test_toxicity(spark):
    docs, labels = toxic_data()
    docs += [(None, "no id", *DATA[0][2:]), (1000, None, *DATA[0][2:]), (1001, "", *DATA[0][2:]), docs[0]]
    labels_df = spark.createDataFrame([*labels, (None, 1, 1), (2000, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, docs), labels_df).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == truth.get(r.doc_id, 0)
    kept = toxicity.drop_toxic(frame(spark, docs), labels_df)
    assert kept.columns == DOCS.replace(",", "").split()[::2] and {r.doc_id for r in kept.collect()} == {i for i, *_ in docs if not truth.get(i, 0)}
    assert toxicity.score_toxicity(frame(spark, docs[:3]), labels_df.limit(0)).count() == 3 and toxicity.score_toxicity(frame(spark, []), labels_df).count() == 0


def test_toxicity_common_opening(spark):
    docs, labels = toxic_data()
    opening = "licensed for any use as long as this line stays where it is, at the top of the text. "
    docs = [(i, opening + t, *rest) for i, t, *rest in docs]
    found = [(i, t, dict((k, x) for k, _, x in labels)[i]) for i, t, *_ in docs] + [(9000, docs[0][1], 0), (9001, None, 0), (9002, "", 0)]
    got = toxicity.whole_texts(spark.createDataFrame(found, "doc_id long, text string, toxic long"))
    assert got.count() == len(docs) + 1 and got.where("toxic = 1").count() == len(docs) // 5
    truth = {i: t for i, _, t in labels}
    scored = toxicity.score_toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.predicted == truth[r.doc_id] for r in scored)


def test_one_edit_automaton():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))): (1.0, False) for _ in range(20)}
    trie = toxicity.Trie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(4, 8)))
        if w not in terms:
            assert bool(trie.near(w)) == any(distance(w, t) == 1 for t in terms)


def test_edits_pass_the_first_test():
    """may_be_near() is true for every word that the automaton accepts."""
    rng = random.Random(8)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 11))): (1.0, False) for _ in range(12)} | {"stemm": (2.0, True), "opened": (2.0, True)}
    m = toxicity.Model(terms, under={"stemming": 1.0})
    for _ in range(4000):
        w = list(rng.choice([*terms, "stemming"]))
        for _ in range(rng.choice([1, 1, 2])):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 2)] = rng.choices("abcdeém", k=rng.randint(0, 2)) if rng.random() < 0.7 else w[i : i + 2][::-1]
            w = w or ["a"]
        word = "".join(w) + rng.choice(["", "", "ing"])
        assert m.may_be_near(word) or not max(m.near.near(word), m.near.swapped(word)) or len(word) < 3, word


def test_quotation_lowers_context():
    m = toxicity.Model({"moron": (5.0, False), "lowei": (4.0, True)}, [0.0] * 7, 0.0)
    plain, quoted = m.features("you are a moron today"), m.features('he said "you are a moron" to them')
    assert plain[1] == 0 and quoted[1] > 0 and quoted[5] < plain[5]
    assert m.look_up("loweikeit") == (2, 4.0) and m.look_up("morron")[0] == 3 and m.look_up("melon")[0] == 0


def test_misspelled_lexicon():
    counts = [("blockheads", 60, 0), ("blockheadish", 40, 0), ("block*", 100, 0), ("dolt", 50, 0), *((f"term{chr(97 + i // 26)}{chr(97 + i % 26)}x", 30, 0) for i in range(400))]
    terms = toxicity.choose_terms(counts, 1000, 9000)
    assert len(terms) == 402 and terms["block"][1]
    m = toxicity.Model(terms, [0.0] * 7, under={"blockheads": 3.0})
    for w in ("blokhead", "blcokheads", "blxckheads", "dolr", "odlt"):
        assert m.look_up(w)[0] == 3, w
    assert m.look_up("blocks")[0] == m.look_up("blockheadz")[0] == 2 and m.look_up("dolt")[0] == 1 and m.look_up("green")[0] == 0
    assert toxicity.Model(terms, ordinary=frozenset(["dole"])).look_up("dole") == (0, 0.0)
    x = m.features("you are a blokhead and a dolr today")
    assert x[3] > 0 and x[4] > 0 and x[5] > 0 and x[6] > 0 and x[5] < m.features("you are a blockhead and a dolt today")[5]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- x --><div class="side-bar ad">Buy now, it is very cheap and good today</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp; block.<br><p>Second <a href="/x">linked</a>
 block &lt;here&gt;.</p><form><input><p>mail</p></form><ul><li>one<li>two</ul><div class="comments"><p>a reader says</p></div></article><aside>more</aside><footer>&copy; us</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\nFirst block.\nSecond linked block <here>.\none\ntwo"
    no_article = PAGE.replace("article>", "div>")
    assert html_text.main_text(no_article).split("\n")[1:3] == ["First block.", "Second linked block <here>."]
    assert html_text.main_text("") == html_text.main_text("<html><body><nav>x</nav></body></html>") == ""
    assert html_text.main_text("just text\n more") == "just text more"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_html_query(spark):
    data = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")]
    got = html_text.extract_text(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 61), ("1", 61), ("2", 0), ("None", 0)] and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _page(inner):
    return "<html><body><nav>" + '<a href="/x">menu</a>' * 12 + f"</nav>{inner}<footer>us</footer></body></html>"


def test_html_density_decides():
    def text(k, n):
        return [f"Paragraph {k} {j} " + "has some words " * n + "in it." for j in range(3)]

    def section(k, n):
        return f"<section><h2>Part {k}</h2>" + "".join(f"<p>{x}</p>" for x in text(k, n)) + "</section>"

    split = _page(f'<div>{section(1, 20)}{section(2, 8)}</div><div>{section(3, 12)}</div><div><a href="/a">one</a> <a href="/b">two</a></div>')
    assert html_text.main_text(split).split("\n") == ["Part 1", *text(1, 20), "Part 2", *text(2, 8), "Part 3", *text(3, 12)]
    body = "".join(f"<p>{x}</p>" for x in text(1, 15))
    for title in ("<h1>A title</h1>", '<div class="top"><h1>A title</h1></div>'):
        assert html_text.main_text(_page(f'{title}<div class="entry">{body}</div>')).split("\n") == ["A title", *text(1, 15)]
    teaser = _page(f'<div class="content">{body}</div><div><article><h3>Teaser</h3><p>Read on</p></article></div>')
    assert html_text.main_text(teaser).split("\n") == text(1, 15)
    loose = _page(f'<div class="content">{text(1, 15)[0]}<br>and <b>more</b> text<p>{text(1, 15)[1]}</p></div>')
    assert html_text.main_text(loose).split("\n") == [text(1, 15)[0] + " and more text", text(1, 15)[1]]


def test_html_self_closed():
    body = "".join(f"<p>Paragraph {j} of the text, with words enough for it.</p>" for j in range(3))
    want = [f"Paragraph {j} of the text, with words enough for it." for j in range(3)]
    for icon in ('<svg class="icon"/>', "<svg/>", "<math/>", '<svg><title>An icon</title><path d="M0 0"/><text>x</text></svg>', "<svg><path d='M0 0'></svg>", "<svg><style/><title/></svg>", "<svg><path/>"):
        assert html_text.main_text(_page(f"{icon}<article>{body}</article>")).split("\n") == want
        assert html_text.main_text(_page(f"<article><h1>Top</h1>{icon}{body}{icon}</article>")).split("\n") == ["Top", *want]
        assert html_text.main_text(_page(f"<article>{icon}{body}</article><div><svg></svg></div>")).split("\n") == want
    formula = "<math><mi>a</mi><mo>=</mo><mn>2</mn></math>"
    assert html_text.main_text(_page(f"<article>{body}<p>Here {formula} holds.</p></article>")).split("\n") == [*want, "Here a=2 holds."]
    assert html_text.main_text(_page(f"<script>if (a < '<svg/>') {{}}</script><article>{body}</article>")).split("\n") == want


def test_html_broken_markup_is_linear():
    import time

    text = "<p>before</p>" + '<a href="' * 40_000
    began = time.perf_counter()
    assert html_text.main_text(text).startswith("before")
    for broken in ("<div>" * 20_000 + "<td>" * 20_000, "<li>" * 20_000 + "x", "<" * 100_000, "<!" * 50_000, "<script>" * 20_000, "<b '" * 30_000 + ">"):
        html_text.main_text(broken)
    assert time.perf_counter() - began < 20
    assert html_text.main_text('<p title="a > b">one</p><script>if (a<b && "x) {}</script><p>two</p>') == "one\ntwo"


class Brute:
    """Densities by the definition, each node's from its own walk over all that stands below it."""

    def __init__(self, page):
        self.root = html_text.parse(page)

    def below(self, node):
        """(characters, tags, characters in links, links) under a node, without furniture."""
        c = t = lc = lt = 0
        for x in node.children:
            if isinstance(x, str):
                c += len(" ".join(x.split()))
            elif not x.drop:
                n = self.below(x)
                c, t = c + n[0], t + n[1] + 1
                lc, lt = (lc + n[0], lt + n[3] + 1) if x.tag == "a" else (lc + n[2], lt + n[3])
        return c, t, lc, lt


def test_html_counts_against_brute_force():
    rng = random.Random(7)

    def block(depth):
        kind = rng.choice(["div", "section", "p", "ul", "p", "nav"])
        if kind == "p" or depth == 0:
            return f"<p>{words(rng, rng.randint(1, 30))}{' <a href=x>' + words(rng, 2) + '</a>' if rng.random() < 0.4 else ''}</p>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a href=y>{words(rng, 2)}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        return f"<{kind}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{kind}>"

    for _ in range(60):
        page = "<html><body>" + "".join(block(3) for _ in range(4)) + "</body></html>"
        brute, root = Brute(page), html_text.parse(page)
        nodes, share = html_text.densities(root)
        density = {}
        for n in nodes:
            if not n.drop:
                assert tuple(n.own) == brute.below(n)
                density[n] = html_text._density(n.own, share)

        def total(n):  # of the densities of its children; the core has the largest, found here by looking at all nodes
            if not n.blocks:
                return density[n]
            return sum(html_text._density(html_text._counts(x)[0], share) if isinstance(x, list) else density[x] for x in html_text._parts(n))

        best, threshold, _ = html_text.core(root)
        body = next(n for n in nodes if n.tag == "body")
        inside = [n for n in html_text._walk(body) if not n.drop and (n.blocks or n.tag in html_text.BLOCK)]
        if any(density[n] for n in inside):
            assert abs(total(best) - max(map(total, inside))) < 1e-9
            up, path = best, []
            while up is not body.parent:
                path.append(min(density[up], html_text._density(up.shown, share)))
                up = up.parent
            assert abs(threshold - min(path)) < 1e-9
