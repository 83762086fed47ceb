"""Languages of many scripts, and what the model is learned from."""

import random
import zlib

import numpy as np

from quoin.llm import language
from tests.llm.helpers import frame
from tests.llm.test_models import plain_phrases

SCRIPTS = {"el": (0x3B1, 24), "ja": (0x3041, 80), "ko": (0xAC00, 900), "la": (0x61, 26), "ru": (0x430, 32), "x-han": (0x20000, 400), "zh": (0x4E00, 900)}


def text(script, seed, n=300):
    start, many = SCRIPTS[script]
    rng = random.Random(seed)
    return "".join(" " if rng.random() < 0.1 else chr(start + min(rng.randrange(many), rng.randrange(many))) for _ in range(n))


def test_letters_of_every_script_are_told_apart():
    model = language.Model({k: [text(k, i) for i in range(40)] for k in SCRIPTS})
    assert len(model.letters) > 1000
    for k in SCRIPTS:
        assert [x for x, _ in model.predict([text(k, 1000 + i) for i in range(5)])] == [k] * 5


def test_further_letters_are_parsed_as_frequent_ones_are():
    samples = {k: [text(k, i, 400) for i in range(6)] for k in ("ko", "la", "zh")}
    model = language.Model(samples)
    table = language.letter_table(model.letters)
    number = lambda t: language.symbols(t, table, model.other)
    spelt = lambda t: "".join(map(chr, number(t)))
    rng = random.Random(3)
    for k, lang in enumerate(model.languages):
        pieces = [samples[lang][rng.randrange(6)][a : a + rng.randint(1, 9)] for a in (rng.randrange(390) for _ in range(150))]
        t = "".join(pieces)
        assert lang == "la" or np.count_nonzero(number(t) > language.ALPHABET)
        assert model.phrases([number(t)])[k, 0] == plain_phrases(spelt(t), list(map(spelt, samples[lang])))


def test_whole_texts_are_learned_from_as_many_for_every_language(spark):
    rows = [(1000 * k + i, text("la", 100 * k + i, 500 + 40 * i), f"l{k:02}", None, None) for k in range(12) for i in range(90)]
    rows += [(50_000 + i, text("ru", 1, 900), "ru", None, None) for i in range(4)]  # one text, repeated
    rows += [(60_000 + i, text("el", i, language.LETTERS + 100 + i), "el", None, None) for i in range(5)]  # longer ones alone
    rows += [(70_000, text("la", 7, 90_000), "l00", None, None), (70_001, None, "l00", None, None), (70_002, "abc", None, None, None)]
    seen = language.sampled(frame(spark, rows).repartition(5))
    known = {(lang, t) for i, t, lang, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(seen) == sorted({r[2] for r in rows if r[2]})
    assert all((lang, t) in known for lang, own in seen.items() for t in own)
    for k in range(12):
        own = seen[f"l{k:02}"]
        assert language.LETTERS <= sum(map(len, own)) < language.LETTERS + max(map(len, own)) and max(map(len, own)) <= language.LETTERS
    assert set(seen["ru"]) == {text("ru", 1, 900)}
    assert [len(t) for t in seen["el"]] == [min(len(t) for lang, t in known if lang == "el")]
    assert seen == language.sampled(frame(spark, rows[::-1]))


def test_nothing_to_learn_from(spark):
    assert language.sampled(frame(spark, [(1, "abc", None, None, None), (2, None, "en", None, None)])) == {}
