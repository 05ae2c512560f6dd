"""op2 against a plain decoder: loops over n-grams, bits and languages."""

import math
import random

from stepweave.llm import language

TEXTS = {"en": "the cat and the dog are in the house with all of their things", "de": "der hund und die katze sind im haus mit allen ihren sachen", "fr": "le chat et le chien sont dans la maison avec toutes leurs choses", "es": "el gato y el perro estan en la casa con todas sus cosas"}


def bins(text):
    """Two to four bytes of the letters, hashed as the model's fixed values say."""
    raw = text.lower().encode()
    raw = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in raw) + b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return [((int.from_bytes(raw[i : i + n], "big") ^ n) * int(language.MIX) % 2**32) >> 16 for n in (2, 3, 4) for i in range(len(raw) - n + 1)]


def decode(model, text):
    own = bins(text)
    z = [sum(float(model.odds[b, k]) for b in own) / math.sqrt(len(own) + 16) for k in range(model.code.shape[1])]
    loss = [sum(float(t) * math.log1p(math.exp(-float(c) * v)) if -float(c) * v < 500 else float(t) * -float(c) * v for c, t, v in zip(code, trust, z, strict=True)) for code, trust in zip(model.code, model.trust, strict=True)]
    like = [math.exp(-4 * (x - min(loss))) for x in loss]
    like = [x / sum(like) for x in like]
    best, second = sorted(like, reverse=True)[:2]
    return model.languages[like.index(best)], best, best - second < model.margin


def test_against_a_plain_decoder(spark):
    r = random.Random(2)
    rows = [(4 * i + k, " ".join(r.choices(t.split(), k=9)), lang) for i in range(50) for k, (lang, t) in enumerate(TEXTS.items())]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(r.choices(t.split(), k=r.randint(1, 30))) for t in TEXTS.values() for _ in range(10)] + ["a", "É!", "the der", "Le 12 chat, el gato", "x" * 3000]
    got = language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for x in got:
        name, score, unsure = decode(model, x["text"])
        assert abs(x["score"] - score) < 1e-3 and (x["lang_pred"] == name and x["ambiguous"] == unsure or abs(score - 0.5) < 0.05)
