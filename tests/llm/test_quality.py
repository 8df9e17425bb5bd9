import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clicklake.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def expected(text):
    """The base measures as they are stated."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for n in range(len(words) - 2):
        if windows[tuple(words[n : n + 3])] > 1:
            inside |= {n, n + 1, n + 2}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_all_documents(spark, sf_dir):
    table = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = quality.op6_quality(spark, sf_dir).collect()
    assert len(rows) == len(table)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == expected(table[r["doc_id"]]["text"])
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert all(good) and sum(bad) <= 0.05 * len(bad)


def test_references_and_distances_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    known = quality.histograms(quality.references(docs, words=5))
    by_language = {}
    for r in docs.collect():
        by_language.setdefault(r["lang"], []).append(r["text"] or "")
    assert known.keys() == by_language.keys()
    for language, texts in by_language.items():
        words = Counter(w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t))
        top = sorted(words, key=lambda w: (-words[w], w.encode()))[:5]
        classes, names, counts = known[language]
        assert names == sorted(top) and counts.tolist() == [*(words[n] for n in names), sum(words.values()) - sum(words[n] for n in names)]
        assert classes.sum() == sum(map(len, texts))
        assert classes[3] == sum(c.isnumeric() for t in texts for c in t)
    row = quality.measured(docs, known=known).filter("word_distance is not null").first()
    classes, names, counts = known[row["lang"]]
    words = Counter(re.findall(r"[^\x20\x09-\x0D]+", row["text"]))
    mine = np.array([*(words[n] for n in names), sum(words.values()) - sum(words[n] for n in names)])
    p, q = mine / mine.sum(), counts / counts.sum()
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    assert row["word_distance"] == pytest.approx(math.sqrt(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2))


def test_distance_is_0_for_the_same_and_1_for_the_disjoint():
    counts = np.array([[2, 2, 0], [0, 0, 5], [0, 0, 0]])
    assert quality.distance(counts, np.array([7, 7, 0])).round(9).tolist() == [0, 1, 0.707106781]


@pytest.mark.parametrize("renamed", ["_row", "_text", "_language", "n_words", "c0", "language"])
def test_odd_documents(odd_documents, no_documents, renamed):
    docs = odd_documents.drop("_row").withColumnRenamed("kind", renamed)
    rows = quality.measured(docs).collect()
    assert len(rows) == docs.count()
    assert set(docs.columns) <= set(rows[0].asDict())
    for r in rows:
        assert tuple(r[n] for n in NAMES) == expected(r["text"])
        if r["n_words"] < quality.LEAST_WORDS:
            assert r["word_distance"] is None
    assert quality.measured(no_documents).count() == 0


def test_many_different_words_in_one_text():
    import pyarrow as pa

    text = " ".join(map(str, range(3000))) + " a b c d a b c"
    words = quality.Words(pa.array([text, "", "a b c a b c", "a a a a"], pa.large_string()))
    assert words.repeated().tolist() == [expected(t)[4] for t in (text, "", "a b c a b c", "a a a a")]


def test_repeats_among_millions_of_words():
    count = 2**21 + 5
    names = [f"{n:x}" for n in range(count)]
    text = " ".join([*names, names[-3], names[-2], names[-1], "z", names[-1], names[0], names[1]])
    words = quality.Words(pa.array([text, "a b c a b c"], pa.large_string()))
    assert len(words.distinct) > 2**21
    # Only the three last names come again as a window; the others meet in new ways.
    assert words.repeated().tolist() == [6, 6]


def test_windows_by_pairs_are_those_of_packed_codes(monkeypatch):
    codes = np.random.default_rng(2).integers(0, 9, 4000)
    packed = np.unique(quality.window_names(codes), return_inverse=True)[1]
    monkeypatch.setattr(quality, "PACKED", 8)
    assert (np.unique(quality.window_names(codes), return_inverse=True)[1] == packed).all()


def test_common_words_are_ranked_without_lists_of_all(spark, monkeypatch):
    texts = {"en": "b b b a a a c c d", "de": "x y y", None: "q", "fr": " "}
    docs = spark.createDataFrame([(lang, f"{text} {' '.join(f'{lang}{n}' for n in range(9000) if lang == 'en')}") for lang, text in texts.items()], "lang string, text string")
    frames, store = [], quality.stored

    def watch(df, name):
        frames.append(df)
        return store(df, name)

    monkeypatch.setattr(quality, "stored", watch)
    found = quality.references(docs, words=2)
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in [*frames, found]]
    assert not any("collect_list" in plan for plan in plans)
    assert any("WindowGroupLimit [language" in plan and "_part" in plan for plan in plans)
    rows = {(r["language"], r["name"]): r["n"] for r in found.filter("is_word").collect()}
    assert rows == {
        ("en", "a"): 3, ("en", "b"): 3, ("en", None): 9003, ("de", "y"): 2, ("de", "x"): 1, ("de", None): 0, (None, "q"): 1, (None, None): 0,
    }
