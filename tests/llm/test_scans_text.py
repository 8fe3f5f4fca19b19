"""Repaired text against the text before the noise, on a corpus of many sentences."""

import random
from collections import Counter

from fixweave.llm.scans import _count_words, _word_counts, clean_scans

SUBJECTS = "The crew|A second aircraft|The tower|The inspector|One instructor|Ground control|The survey team|Each student|The night shift|Our planner|The airport authority|A local pilot".split("|")
VERBS = "reported|noticed|described|questioned|confirmed|repeated|ignored|recorded|corrected|accepted".split("|")
OBJECTS = "heavy turbulence|the missing approach light|an unexpected holding pattern|a different minimum altitude|the published gradient|several birds|the outbound heading|a weak localizer signal|the closed taxiway|an early descent|the amended procedure|rain showers".split("|")
PLACES = "near the northern threshold|beyond the river|over the second waypoint|during the missed approach|before the final turn|after sunset|west of the old hangar|without further clearance|inside the restricted area|above the glide path".split("|")
CONFUSIONS = [("m", "rn"), ("e", "c"), ("l", "1"), ("o", "0"), ("h", "b"), ("u", "ii"), ("t", "f"), ("g", "q"), ("d", "cl"), ("i", "l")]
HEADERS = ["REGIONAL FLIGHT NOTES VOL 12", "Printed for training use only", "ADDENDUM"]


def sentence(r):
    text = f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(PLACES)}"
    return f"{text} at {r.randint(10, 99) * 100} feet." if r.random() < 0.4 else f"{text}."


def wrapped(text, width):
    lines, line = [], []
    for w in text.split():
        if line and len(" ".join([*line, w])) > width:
            lines.append(" ".join(line))
            line = []
        line.append(w)
    return [*lines, " ".join(line)]


def page(r):
    """A clean text and the same text as a page shows it, with the kinds of noise put in."""
    clean = " ".join(sentence(r) for _ in range(r.randint(3, 6)))
    kinds, words = set(), clean.split()
    if r.random() < 0.5:
        for _ in range(r.randint(1, 2)):
            i = r.randrange(len(words))
            fits = [(a, b) for a, b in CONFUSIONS if a in words[i][1:] and len(words[i]) > 5 and words[i].isalpha()]
            if fits:
                a, b = r.choice(fits)
                at = words[i].index(a, 1)
                words[i] = words[i][:at] + b + words[i][at + len(a) :]
                kinds.add("misread")
    lines = wrapped(" ".join(words), r.randint(40, 60))
    if r.random() < 0.5:
        for k in range(len(lines) - 1):
            head, _, rest = lines[k + 1].partition(" ")
            if len(head) > 7 and head.isalpha() and head in clean and rest and r.random() < 0.5:
                cut = r.randint(3, len(head) - 3)
                lines[k] += f" {head[:cut]}-"
                lines[k + 1] = f"{head[cut:]} {rest}"
                kinds.add("hyphenation")
    if r.random() < 0.3:
        lines.insert(r.randrange(len(lines) + 1), r.choice(HEADERS))
        kinds.add("running_header")
    if r.random() < 0.3:
        lines.insert(r.choice([0, len(lines)]), f"Page {r.randint(1, 300)}")
        kinds.add("page_number")
    return clean, "\n".join(lines), sorted(kinds)


def test_repaired_text_against_the_original(spark):
    r = random.Random(8)
    pages = [page(r) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(pages)], "rec_id long, text string")
    got = {x.rec_id: x for x in clean_scans(df, "rec_id", "text").collect()}
    exact = sum(got[i].repaired == clean for i, (clean, _, _) in enumerate(pages))
    right = total = 0
    for i, (clean, _, _) in enumerate(pages):
        have = Counter(got[i].repaired.split())
        right += sum((Counter(clean.split()) & have).values())
        total += max(len(clean.split()), sum(have.values()))
    kinds = sum(got[i].noise == k for i, (_, _, k) in enumerate(pages))
    print({"texts exact": exact / len(pages), "words right": right / total, "kinds right": kinds / len(pages)})
    assert exact >= 0.9 * len(pages) and right >= 0.995 * total and kinds >= 0.95 * len(pages)


def test_words_are_counted_as_in_plain_python(spark):
    texts = ['Climb to 4500, "then" (hold) ... 12\u00a0nm\tleft;', "", None, "a a; A. ;", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain: dict = {}
    for t in texts:
        if t:
            _count_words(t, plain)
    assert {x.entry: x.n for x in _word_counts(df, "text").collect()} == dict(plain["word"])
