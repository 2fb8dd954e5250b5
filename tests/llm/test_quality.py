import random
import re
from collections import Counter

from objekta.llm import quality


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, again = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            again |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def texts():
    rng = random.Random(8)
    vocabulary = ["a", "Bé", "|", "x$", "long", "日本", "!!", "end."]
    out = [None, "", " \n", "one", "\x0b\x0c\r\n", "same line\nsame line\n\n \n\nsame line \nother", "And " * 40, "a b c d e f g h i " * 3, "a b c d e f g h a b c d e f g h", "w" * 50000, "q " * 30000]
    for _ in range(80):
        part = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))
        out.append(part + rng.choice(["", " mid ", "\n"]) + (part if rng.random() < 0.3 else "") + rng.choice(["", "\x0b", "\r\n"]) + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(30))))
    return out


def test_statistics_against_brute_force(spark):
    docs = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "null id", "x"), (5, "a" * 30, "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, w string")
    got = quality.judge(frame, [], "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, got)) == Counter((d, *brute(t)) for d, t, _ in docs)
    assert quality.judge(frame.limit(0), [], "doc_id").count() == 0


def labelled(n, rng):
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        w = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.randrange(25, 200))]
        if bad:
            w = [x.upper() + "!!" if i % 2 else "| " + x for x in w]
        docs.append((i, " ".join(w), "row"))
        labels.append((i, 0 if bad else 1, None))
    return docs, labels


def test_learned_list_on_held_out_documents(spark):
    rng = random.Random(3)
    docs, labels = labelled(900, rng)
    d = spark.createDataFrame(docs, "doc_id long, text string, row string")
    fit_on = spark.createDataFrame([*labels[:600], (None, 0, 0), (1, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(d, fit_on)
    assert rules and all(1 <= len(r) <= quality.MOST_CONDITIONS for r in rules)
    kept = {r.doc_id: r.kept for r in quality.judge(d, rules, "doc_id").collect()}
    held = [(kept[i], bool(q)) for i, q, _ in labels[600:] if i in kept]
    right = sum(k == q for k, q in held) / len(held)
    clean_kept = sum(k for k, q in held if q) / sum(q for _, q in held)
    assert right > 0.97 and clean_kept > 0.98
    out = quality.filter_quality(d, fit_on)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}
    assert quality.fit(d, fit_on.where("quality = 1")) == [] and quality.fit(d, fit_on.limit(0)) == []
    assert quality.learn([]) == []
