"""The numpy kernels against plain versions."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from tarnlake.llm import bpe, jaccard, langid, media, queries, toxicity
from tarnlake.llm.arrowtext import Hasher, flat, pieces, runs
from tarnlake.llm.chain import Chain
from tarnlake.llm.quality import fit_quality, line_features
from tarnlake.llm.sharding import quotas
from tarnlake.llm.topk import ImpactIndex

ODD = ["", None, "a", " \t\n", "Hello, World", "é" * 300, "x y " * 2000, "日本語 テキスト", "a\x00b \x1c c\x85d"]


def test_flat_and_pieces():
    data, edges = flat(pa.array(ODD, pa.string()))
    assert [bytes(data[a:b]).decode() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [t or "" for t in ODD]
    batch = pa.record_batch([pa.array(ODD, pa.string())], ["t"])
    assert [x for p in pieces(batch, "t", 50) for x in p.column(0).to_pylist()] == ODD
    assert [x for p in pieces(batch.slice(2, 4), "t", 1) for x in p.column(0).to_pylist()] == ODD[2:6]


def test_runs_stop_at_row_edges():
    data, edges = flat(pa.array(["ab c", "", "de", " f "]))
    starts, ends, per = runs(data != 32, edges)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"ab", b"c", b"de", b"f"]
    assert per.tolist() == [2, 0, 1, 1]


def test_hashes_depend_on_content_alone():
    data = np.frombuffer(b"abcabcab", np.uint8)
    h = Hasher(data)(np.array([0, 3, 1, 0]), np.array([3, 6, 4, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def _brute(scores, move, begin):
    n = len(scores)
    weight = {y: np.exp(begin * y[0] + sum(s * v for s, v in zip(scores, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
    total = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    move, begin = rng.normal(size=(2, 2)), 0.4
    sizes = [1, 5, 3, 8, 1, 2]
    scores = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(scores), bool)
    first[np.cumsum(sizes) - sizes] = True
    p, pairs = Chain(move, begin).marginals(scores, first)
    want = [x for a, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True) for x in _brute(scores[a : a + n], move, begin)]
    assert np.allclose(p, want)
    inner = ~np.append(first[1:], True)
    assert np.allclose(pairs[inner].sum(1), 1) and np.allclose(pairs[inner][:, 2:].sum(1), p[inner])


def test_long_chain_stays_finite():
    p, _ = Chain(np.array([[5.0, -5], [-5, 5]]), 0.0).marginals(np.tile([20.0, -20.0], 5000), np.arange(10000) == 0)
    assert np.isfinite(p).all()


def test_quality_learns_lines():
    good = ["the cat sat on the mat and looked at the quiet sea\nwhile rain fell softly over town"] * 20
    bad = ["BUY!! NOW!! CHEAP!! CLICK!!\nWIN!! BIG!! TODAY!!"] * 20
    model = fit_quality(good + bad, [1] * 20 + [0] * 20)
    s = model.scores(*flat(pa.array([good[0], bad[0], "", None])))
    assert s[0] > 0.7 > s[1] and s[2] == s[3] == 0
    alone = fit_quality([], [])
    assert alone.scores(*flat(pa.array(["x", None]))).tolist() == [0.5, 0]


def test_line_features_cut_very_long_lines():
    data, edges = flat(pa.array(["a" * (3 << 20), "b\n\nc"]))
    x, size, per = line_features(data, edges)
    assert per.tolist() == [3, 2] and size.sum() == (3 << 20) + 2 and np.isfinite(x).all()


def test_toxicity_finds_offsets():
    clean = ["such an eye on a fine day", "we walk to the river", "birds sing all morning"] * 20
    toxic = ["you are an idiot today", "what a moron he is", "idiot and moron again"] * 10
    model = toxicity.fit_toxicity(clean + toxic, [0] * 60 + [1] * 30)
    text = "é such an IDIOT indeed"
    data, edges = flat(pa.array([text, clean[0], ""]))
    starts, ends, per, p = model.tags(data, edges)
    assert [bytes(data[a:b]).decode() for a, b, x in zip(starts, ends, p, strict=True) if x > 0.5] == ["IDIOT"]
    s = model.scores(data, edges)
    assert s[0] > 0.7 > s[1] and s[2] < 0.7
    assert toxicity.fit_toxicity(["a"], [0]).scores(*flat(pa.array(["idiot"])))[0] < 0.5


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_is_the_librarys(library):
    mine = bpe.encoder(queries.tokenizer_path())
    texts = [
        *ODD, "Hello <|endoftext|>World's it'S I'LL we'd 1234 ñandú ΑΣ Σ. ΟΔΥΣΣΕΥΣ İstanbul", "<|startoftext|>", "!!!???", "a" * 5000, "aaa aaaa aaaaaaa",
        "\x00\x01 \x1f", "ẞ ǅ ᾳ Ώ ª º ² ½ Ⅷ ٣ 😀😀 é ﬁ ​", "<|endoftext", "the the. the, the! (the)", "x　y z",
    ]
    ids, edges = mine.encode(texts)
    said, numbers = mine.joined(ids, edges, mine.shown), mine.joined(ids, edges, mine.numbers)
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[edges[k] : edges[k + 1]].tolist() == want
        assert str(said[k], "utf-8") == library.decode(want, skip_special_tokens=False) == mine.decode(want)
        assert str(numbers[k], "utf-8") == " ".join(map(str, want))


def test_bpe_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    mine = bpe.WordBpe.load(queries.tokenizer_path())
    for texts in (["one two three", "four five six seven"], ["two eight", "nine ten eleven twelve one"]):
        ids, edges = mine.encode(texts)
        for k, t in enumerate(texts):
            assert ids[edges[k] : edges[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def _shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def test_shingle_counts():
    texts = [*ODD, "A b C d e a b c d E", "one two", "one TWO three", "é x é x é x é x"]
    _, n = jaccard.shingles(*flat(pa.array(texts, pa.string())))
    assert n.tolist() == [len(_shingles(t)) for t in texts]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for size in (1, 2, 6, 7, 12, 33, 51, 200, 412, 1500):
        for _ in range(25):
            base = rng.integers(1, 2**63, size, dtype=np.uint64)
            larger = int(rng.integers(size, max(size + 1, size * 100 // 85 + 1)))
            differ = 15 * (size + larger) // 185
            lost = (differ - (larger - size)) // 2
            if lost < 0:
                continue
            other = np.concatenate([base[lost:], rng.integers(1, 2**63, larger - size + lost, dtype=np.uint64)])
            assert 100 * (size - lost) >= 85 * (larger + lost)
            sig, owner = jaccard.signatures(np.concatenate([np.sort(base), np.sort(other)]), np.array([size, larger]))
            assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size
            s = jaccard.sketches(np.concatenate([base, other]), np.array([size, larger]))
            assert sum(int(x).bit_count() for x in (s[0] ^ s[1]).view(np.uint64)) <= larger - size + 2 * lost


def test_wide_sketches_fold():
    rng = np.random.default_rng(1)
    h, n = rng.integers(1, 2**63, 1700, dtype=np.uint64), np.array([0, 700, 1000])
    bits, at = jaccard.wide_sketches(h, n)
    assert np.diff(at).tolist() == [1, 32, 32]
    wide, _ = jaccard.wide_sketches(np.concatenate([h[:700], h[:700]]), np.array([1400]))
    assert not wide.any()  # every element twice
    wide, _ = jaccard.wide_sketches(np.concatenate([h[:700], np.repeat(h[700:1700], 2)]), np.array([2700]))
    while len(wide) > 32:
        half = wide.reshape(2, -1)
        wide = half[0] ^ half[1]
    assert (wide == bits[at[1] : at[2]]).all()


def test_similar_sets_share_a_signature_at_80():
    rng = np.random.default_rng(2)
    total = several = 0
    for size in (4, 5, 9, 33, 51, 101, 200, 412, 1500):
        for _ in range(25):
            base = rng.integers(1, 2**63, size, dtype=np.uint64)
            lost = size // 9  # size - lost of size + lost in common: 0.8 at least
            other = np.concatenate([base[lost:], rng.integers(1, 2**63, lost, dtype=np.uint64)])
            assert 100 * (size - lost) >= 80 * (size + lost)
            sig, owner = jaccard.signatures(np.concatenate([np.sort(base), np.sort(other)]), np.array([size, size]), 80)
            assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size
            total, several = total + 2 * size, several + len(sig)
    assert several < 2 * total  # one set of signatures in each band, nearly always


def test_subsets_are_enumerated():
    for row in jaccard.bands(5000).tolist():
        lo, hi, k, d, m, parts, spare = row
        assert lo <= hi and parts * (d + 1) > k >= (parts - 1) * (d + 1) and (k == 0 or m - d >= 2)
    h, n = np.sort(np.random.default_rng(5).integers(1, 2**63, 1000, dtype=np.uint64)), np.array([1000])
    (row,) = [r for r in jaccard.bands(1000).tolist() if r[0] <= 1000 <= r[1]]
    sig, _ = jaccard.signatures(h, n)
    assert len(sig) >= 3 * row[5]  # three subsets of two of each part's three


def test_signatures_without_tries_sign_empty_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "TRIES", 1)
    test_similar_sets_share_a_signature()


def test_companding_tables_and_adpcm():
    assert media.MULAW[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, media.BLOCK * 5).astype(np.uint8)
    got = media.adpcm(data).reshape(5, -1)
    for b in range(5):
        block = data[b * 64 : b * 64 + 64]
        last = int(np.frombuffer(block[:2].tobytes(), "<i2")[0])
        index, want = min(int(block[2]), 88), [last]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media._STEPS[index])
                d = step >> 3
                d += step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
                last = max(-32768, min(32767, last + (-d if code & 8 else d)))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(last)
        assert got[b].tolist() == want


def test_media_round_trip():
    names = tuple(media._KINDS)
    texts = [*ODD, *(f"text {i}" for i in range(30))]
    found = media.audio_of(texts, names)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        codec, back = media.loaded(found["media"][k])
        assert back == payload and found["payload_sha256"][k] == hashlib.sha256(payload).hexdigest() and found["n_bytes"][k] == len(raw)
        pcm = media.expand(codec, np.frombuffer(payload, np.uint8))
        assert np.array_equal(np.frombuffer(found["pcm"][k], np.int16)[::2], pcm)
    assert {f.split(":")[0] for f in found["feature"]} == set(media.CODECS)
    with pytest.raises(ValueError):
        media.loaded(b"nothing")


def test_language_windows_cover_texts():
    data, edges = flat(pa.array(["abc", "", "x" * 500, "y" * 192]))
    x, row, own = langid.windows(data, edges)
    assert row.tolist() == [0, 2, 2, 2, 3] and own.tolist() == [3, 192, 192, 116, 192] and x.shape[1] == langid.WINDOW


def test_folded_tables_are_the_network():
    rng = np.random.default_rng(2)
    f = [rng.normal(size=(k * langid.EMBED, langid.FILTERS)) for k in langid.WIDTHS]
    embed = rng.normal(size=(256, langid.EMBED))
    m = langid.LangModel(["a"], embed, f, np.zeros(24, np.float32), np.zeros((24, 1)), np.zeros(1))
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    e = embed[x]
    want = [np.concatenate([e[:, i : langid.WINDOW - k + 1 + i] for i in range(k)], 2) @ w for k, w in zip(langid.WIDTHS, f, strict=True)]
    assert np.allclose(m.pooled(x), np.maximum(np.concatenate([w.max(1) for w in want], 1), 0), atol=1e-3)


def test_impact_index_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, d = rng.integers(1, 500), rng.integers(1, 9)
        w = rng.integers(-4, 5, (n, d)) * rng.integers(1, 60)
        ids = rng.integers(0, 300, n)
        got, score = ImpactIndex(ids, w).search(w[0], 5, ids[0])
        s, on = w @ w[0], np.flatnonzero(ids != ids[0])
        best = on[np.lexsort((ids[on], -s[on]))[:5]]
        assert got.tolist() == ids[best].tolist() and score.tolist() == s[best].tolist()


def test_impacts_may_be_of_any_size():
    rng = np.random.default_rng(7)
    w = rng.integers(-40, 41, (3000, 16))
    w[5, 3], w[6, 2], w[7] = 256_000_000, -256_000_000, 0
    ids = np.arange(3000)
    index = ImpactIndex(ids, w)
    for i in (0, 5, 6, 7, 100, 200):
        for floor in (None, int(np.sort(np.delete(w @ w[i], i))[-5])):
            got, score = index.search(w[i], 5, i, floor)
            s = w @ w[i]
            on = np.delete(ids, i)
            best = on[np.lexsort((on, -s[on]))[:5]]
            assert got.tolist() == best.tolist() and score.tolist() == s[best].tolist()
    assert 0 < index.processed < index.all


def test_exchanges_keep_counts():
    rng = np.random.default_rng(5)
    for _ in range(50):
        wants = {(i, j): int(rng.integers(0, 9)) for i in range(5) for j in range(5) if i != j}
        free = {j: int(rng.integers(0, 9)) for j in range(5)}
        move, sent = quotas(wants, free, 5)
        flow = dict.fromkeys(range(5), 0)
        for (i, j), n in move.items():
            assert n <= wants[i, j]
            flow[i] -= n
            flow[j] += n
        for j, parts in sent.items():
            assert sum(n for _, n in parts) <= free[j]
            for i, n in parts:
                flow[j] -= n
                flow[i] += n
        assert set(flow.values()) == {0}
