"""Language identification by held-out accuracy; audio columns by round trips and brute force."""

import numpy as np
import pytest

from tessera.llm import language, media
from tessera.llm.common import remainder, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    documents = table(spark, SF, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language.train(documents.filter(~held_out))
    made = language.predict(documents.filter(held_out), model, keep=("lang",)).collect()
    assert np.mean([r.lang == r.lang_pred for r in made]) > 0.95
    assert all(0 <= r.score <= 1 for r in made)
    assert 0.005 < (model.table != 0).mean() < 0.5


def test_temperature_is_calibrated(spark):
    documents = table(spark, SF, "documents")
    model = language.train(documents)
    made = language.predict(documents, model, keep=("lang",)).toPandas()
    assert abs((made["lang"] == made["lang_pred"]).mean() - made["score"].mean()) < 0.05


def test_language_edges(documents, none):
    model = language.train(documents)
    assert model.languages == ["en"]
    rows = language.predict(documents, model, keep=("text",)).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert language.train(none).languages == []
    assert {r.lang_pred for r in language.predict(documents, language.train(none)).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_ngrams_stay_in_their_text():
    apart = [language.counts([t])[0] for t in ("ab", "", "Cd-é!")]
    for (a, x), (b, y) in zip(apart, language.counts(["ab", "", "Cd-é!"])):
        assert a.tolist() == b.tolist() and np.allclose(x, y)


def plain_frequencies(sets):
    often = np.zeros(language.BUCKETS)
    for ids in sets:
        for i in set(ids.tolist()):
            often[i] += 1
    return often, len(sets)


HOSTILE = ["ab cd " * 40, "abc" * 100, "é.1 \n" * 50, "x" * 64 + " " * 200 + "y", "", None, "... 12", "word. another, 3 words! " * 13]


@pytest.mark.parametrize("size", [7, 64])
def test_long_texts_in_parts(monkeypatch, size):
    want = language.counts(HOSTILE)
    model = language.fit([("p", *want[0]), ("q", *want[1]), ("p", *want[7]), ("q", *want[2])], *plain_frequencies([x for x, _ in want]))
    scores = model.predict(HOSTILE)
    monkeypatch.setattr(language, "PART", size)
    assert any(len(list(language.parts(t or ""))) > 3 for t in HOSTILE)
    for (a, x), (b, y) in zip(want, language.counts(HOSTILE)):
        assert a.tolist() == b.tolist() and np.allclose(x, y)
    again = model.predict(HOSTILE)
    assert scores[0] == again[0] and np.allclose(scores[1], again[1])


@pytest.mark.parametrize("size", [16, language.PART])
def test_frequencies_cover_all_texts(spark, monkeypatch, size):
    monkeypatch.setattr(language, "PART", size)
    df = spark.createDataFrame([(t,) for t in HOSTILE * 3], "text string").repartition(4)
    often, n = language.frequencies(df, "text")
    want, m = plain_frequencies([x for t, (x, _) in zip(HOSTILE, language.counts(HOSTILE)) if t is not None] * 3)
    assert n == m and np.array_equal(often, want)


def test_fit_is_follow_the_regularised_leader(monkeypatch):
    """Coordinate by coordinate, with dictionaries."""
    texts = [("p", "abab ba"), ("q", "cdcd dc"), ("r", "xyx yx"), ("p", "ab ab"), ("q", "dcd cd"), ("r", "yxy"), ("p", "ba b")] * 3
    rows = [(x, *language.counts([t])[0]) for x, t in texts]
    often, n_docs = plain_frequencies([ids for _, ids, _ in rows])
    model = language.fit(rows, often, n_docs)
    seen, names, z, n = [r for i, r in enumerate(rows) if i % 5 != 4], ["p", "q", "r"], {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= language.L1:
            return 0.0
        return -(z[key] - np.sign(z[key]) * language.L1) / ((language.BETA + n.get(key, 0.0) ** 0.5) / language.ALPHA + language.L2)

    idf = {i: np.log((1 + n_docs) / (1 + often[i])) + 1 for _, ids, _ in rows for i in ids.tolist()}
    order = np.random.default_rng(1)
    for _ in range(language.EPOCHS):
        for at in order.permutation(len(seen)):
            language_, ids, tf = seen[at]
            x = {int(i): language.SCALE * f * idf[int(i)] for i, f in zip(ids, tf)} | {"bias": 1.0}
            score = [sum(v * weight((i, k)) for i, v in x.items()) for k in names]
            p = np.exp(np.array(score) - max(score))
            p /= p.sum()
            before = {(i, k): weight((i, k)) for i in x for k in names}
            for k, pk in zip(names, p):
                for i, v in x.items():
                    g = v * (pk - (k == language_))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / language.ALPHA * before[i, k]
                    n[i, k] = old + g * g
    for k, name in enumerate(names):
        assert model.bias[k] == pytest.approx(weight(("bias", name)), abs=1e-9)
        for i in idf:
            assert model.table[k, i] == pytest.approx(weight((i, name)) * idf[i], rel=1e-5, abs=1e-7)


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.train(df)


def test_prediction_does_not_depend_on_neighbours():
    rows = [(x, *language.counts([t])[0]) for x, t in [("p", "abab"), ("q", "cdcd"), ("p", "ab ab"), ("q", "dcd"), ("p", "ba")]]
    model = language.fit(rows, *plain_frequencies([ids for _, ids, _ in rows]))
    texts = ["ab", None, "cd cd", "", "x1", "abcd" * 50]
    lang, score = model.predict(texts)
    for t, x, s in zip(texts, lang, score):
        (x1,), (s1,) = model.predict([t])
        assert x == x1 and s == pytest.approx(s1, abs=1e-9)


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "words é " * 5000])
def test_wav_round_trip(text):
    raw = (text or "").encode()
    payload = media.payload_of(text)
    assert payload.startswith(raw) and len(payload) % 64 == 0 and payload and not payload[len(raw) :].strip(b"\0")
    assert len(payload) - len(raw) <= 64
    assert media.read_wav(media.to_wav(payload)) == (payload, media.RATE)
    start, end, tensor = media.read_tensors(media.describe(media.to_wav(payload))[0])
    assert tensor.shape[1:] == (media.TENSOR_FRAMES, media.BANDS) and (end > start).all()
    assert end[-1] == pytest.approx(len(payload) / media.RATE, abs=1e-3)


@pytest.mark.parametrize("n", [1, 5, 64, 333])
@pytest.mark.parametrize(("up", "down"), [(3, 4), (1, 2), (2, 1)])
def test_resample_is_the_convolution(n, up, down):
    x = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    taps = media.phases(up, down)[:, ::-1].T.ravel()
    spread = np.zeros(n * up)
    spread[::up] = x
    full = np.convolve(spread, taps)[media.HALF * up :: 1]
    want = np.pad(full, (0, up * down))[::down][: -(-n * up // down)]
    assert np.allclose(media.resample(x, up, down), want, atol=1e-4)


def test_tone_is_kept():
    t = np.arange(16000) / media.RATE
    mels, energy = media.log_mel(media.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32)), 12000)
    assert np.ptp(mels[5:-5].argmax(1)) == 0 and np.allclose(energy[5:-5], -3.01, atol=0.1)


def test_segments_are_hysteresis():
    energy = np.array([0, 0, 0, 5, 0.5, 0, -1, 0.5, 0.5, -1, -1, 9, 9, -2, 0.0])
    found = media.segments(energy, media.HOP, 10**9)
    want, on = [], False
    for i, e in enumerate(energy - np.median(energy)):
        if not on and e >= media.START_DB:
            on, first = True, i
        if on and e < media.END_DB:
            on = False
            want.append(first)
    assert [round(a) for a, _ in found] == want


def test_audio_columns(documents, none):
    rows = media.audio_columns(documents).collect()
    want = sorted((r.doc_id, len((r.text or "").encode())) for r in documents.collect())
    assert sorted((r.doc_id, r.n_bytes) for r in rows) == want
    assert len({r.log_mel for r in rows}) == len({r.media for r in rows})
    assert media.audio_columns(none).count() == 0
