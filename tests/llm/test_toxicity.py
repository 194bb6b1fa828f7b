import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from beatwire.llm.catalog import QUERIES
from beatwire.llm.toxicity import (BETWEEN, CLASS_OF, N, Restorer, batch_counts, decode, fit,
                                   log_model, logistic, readings, score_texts)

CORPUS = ["the quick brown fox and the stupid idiot moron with scum and trash " * 30,
          "a loser or a pathetic worthless clown is disgusting to the people of this town " * 30]
MODEL = log_model(batch_counts(CORPUS))


def test_counts():
    counts = batch_counts(["ab", None, "", "AB é漢"]).reshape(N, N, N)
    assert counts[BETWEEN, 1, 2] == 2 and counts[1, 2, BETWEEN] == 2
    assert np.allclose(np.exp(log_model(counts)).sum(axis=2), 1, atol=1e-4)


def brute_decode(chars):
    """The best of all readings, one by one."""
    best = {(): 0.0}
    for options in readings(chars):
        best_next = {}
        for way, score in best.items():
            for c, cost in options:
                new = way if c is None else (*way, c)
                gain = 0.0
                if c is not None:
                    a, b = (BETWEEN, BETWEEN, *way)[-2:]
                    gain = float(MODEL[a, b, c])
                value = score + cost + gain
                if value > best_next.get(new, -np.inf):
                    best_next[new] = value
        best = best_next
    ends = {w: s + float(MODEL[(BETWEEN, BETWEEN, *w)[-2], (BETWEEN, BETWEEN, *w)[-1], BETWEEN])
            for w, s in best.items()}
    return max(ends.values())


@pytest.mark.parametrize("chars", ["1d10t", "m0r0n", "stuuupid", "p@th3t!c", "i d i o t", "a.b", "$$x"])
def test_viterbi_is_the_best_reading(chars):
    word = decode(chars, MODEL)
    options = readings(chars)
    # the score of the decoded word is the best score of any reading
    best = brute_decode(chars)
    states = {(): 0.0}
    for choice in options:
        after = {}
        for way, score in states.items():
            for c, cost in choice:
                new = way if c is None else (*way, c)
                a, b = (BETWEEN, BETWEEN, *way)[-2:]
                value = score + cost + (0.0 if c is None else float(MODEL[a, b, c]))
                after[new] = max(value, after.get(new, -np.inf))
        states = after
    way = tuple(CLASS_OF.get(c, BETWEEN) for c in word)
    a, b = (BETWEEN, BETWEEN, *way)[-2:]
    assert states[way] + float(MODEL[a, b, BETWEEN]) == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("text,word", [
    ("m0r0n!", "moron"), ("you tr@sh", "trash"), ("$cum", "scum"), ("stuuuupid", "stupid"),
    ("m o r o n", "moron"), ("s.c.u.m", "scum"), ("l-o-s-e-r now", "loser"), ("d1sgu5t1ng", "disgusting"),
    ("plain Stupid", "stupid"), ("st*pid", "stupid")])
def test_restored(text, word):
    assert word in Restorer(MODEL).words(text)


@pytest.mark.parametrize("text,word", [
    ("iddiioott", "idiot"), ("you stuupid", "stupid"), ("s t u p ! d", "stupid"),
    ("$ t u p i d", "stupid"), ("s*t*u*p*!*d", "stupid"), ("i  d i - o t", "idiot"),
    ("i/d/i/o/t", "idiot"), ("st/upid", "stupid"), ("m\to\tr\to\tn", "moron"), ("s, c, u, m", "scum"),
    ("i dd i oo t", "idiot"), ("f o x", "fox"), ("m o r o n !!", "moron"), ("the f 0 x.", "fox")])
def test_restored_from_any_disguise(text, word):
    assert word in Restorer(MODEL).words(text)


def test_nothing_to_restore():
    assert Restorer(MODEL).words("THE!! a$$$ fox, (quick) 12 555-1234") >= {"the", "a", "fox", "quick"}
    assert Restorer(MODEL).words(None) == set() == Restorer(MODEL).words("")
    long = Restorer(MODEL).words("a " * 30_000 + "x" * 20_000)
    assert "a" in long


def test_logistic():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4_000, 2))
    y = (rnd.random(4_000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.allclose(logistic(x, y), [0.5, 2, -1], atol=0.25)


def made(n, seed):
    rnd = random.Random(seed)
    clean = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}rd" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(clean, k=40)
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["stupid", "st00pid", "s t u p i d", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_scores(spark, docs_of):
    rows, labels = made(600, 1)
    docs = docs_of(*rows, (10_000, None), (10_001, ""), (None, "you moron"), (5, rows[5][1]),
                   (10_002, "m o r o n " * 20_000), extra="score words toxic t")
    table = spark.createDataFrame([*labels, (77, None), (None, 1), (10_000, 0)], "doc_id long, toxic int")
    fitted = fit(docs, table)
    got = score_texts(docs, fitted).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[10_000].predicted == by[10_001].predicted == 0 and by[None].predicted == 1
    assert by[10_002].predicted == 1 and by[None].held_out is False
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
                        for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_learns_words_of_a_few_toxic_texts(spark, docs_of):
    """A word in under 1.5 % of the toxic texts, and in no other text."""
    rnd = random.Random(4)
    clean = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}rd" for i in range(200)]
    ids = [i for i in range(8_000) if zlib.crc32(str(i).encode()) % 5]
    toxic = set(ids[:640])
    rows = [(i, " ".join([*rnd.choices(clean, k=5), *["moron"] * (i in toxic and k >= 9),
                          *["zgulk"] * (k < 9)])) for k, i in enumerate(ids)]
    docs = docs_of(*rows, (9_000, "a zgulk"), (9_001, "a fox"))
    fitted = fit(docs, spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int"))
    assert fitted.weights["zgulk"] > 1.5 and not any(w in fitted.weights for w in clean)
    by = {r.doc_id: r.predicted for r in score_texts(docs, fitted).collect()}
    assert by[9_000] == by[ids[0]] == 1 and by[9_001] == 0


def test_letters_of_any_script(spark, docs_of):
    from beatwire.llm.toxicity import class_of, count_trigrams, language_model, packed
    texts = ["głupi łotr œuvre " * 40, "глупый дурак " * 40, "stupid fox é漢字 " * 40, None, ""]
    grams = count_trigrams(docs_of(*enumerate(texts)))
    counts = {r["at"]: r.n for r in grams.collect()}
    assert counts[packed(class_of("г"), class_of("л"), class_of("у"))] == 40
    assert counts[packed(BETWEEN, class_of("g"), class_of("ł"))] == 40
    assert packed(class_of("g"), BETWEEN, class_of("u")) not in counts
    model = language_model(grams)
    every = {*range(N), *model.ones}
    for a, b in [(0, 0), (class_of("г"), class_of("л")), (class_of("g"), class_of("ł")), (1, 2)]:
        assert sum(np.exp(model[a, b, c]) for c in every) == pytest.approx(1, abs=1e-4)
    restorer = Restorer(model)
    for text, word in [("głuuupi", "głupi"), ("дуууррак", "дурак"), ("г л у п ы й", "глупый"),
                       ("д.у.р.а.к", "дурак"), ("ł0tr", "łotr"), ("œuvr3", "œuvre"), ("$tupid", "stupid")]:
        assert word in restorer.words(text), text
    few = Restorer(language_model(grams, most=3))
    assert "stupid" in few.words("$tupid") and "д" in "".join(few.words("ддурак"))


def test_held_out_labels_are_not_read(spark, docs_of):
    rows, labels = made(300, 2)
    docs = docs_of(*rows)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    schema = "doc_id long, toxic int"
    one, two = (fit(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert one.weights == two.weights and np.array_equal(one.beta, two.beta)


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of((1, "a b"), (2, None))
    assert [r.predicted for r in score_texts(docs, fit(docs, none)).collect()] == [0, 0]
    empty = docs.limit(0)
    assert score_texts(empty, fit(empty, none)).collect() == []


def test_query_on_held_out_rows(spark):
    """A few dozen labels of one language: no false alarms, most of what was learnable."""
    tables = Path("/root/testdata/sf0.01")
    if not tables.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, str(tables)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted != truth[r.doc_id] for r in held) <= 0.04 * len(held)
    assert all(r.predicted == truth[r.doc_id] for r in held if r.doc_id in english)
