import random

import pytest

from fixweave.llm import labelled
from fixweave.llm.crf import Chain
from fixweave.llm.personal import CASE_SHARE, Finder, case_profile, corpus_cases, count_cases, find_personal, redact, tagger, tokens_of, train


def cases_of(texts):
    return {w: case_profile(*n) for w, n in count_cases(texts).items() if sum(n[:3]) >= 3}


@pytest.fixture(scope="module")
def finder():
    return Finder(train(cases_of(t for t, _ in labelled.examples()), fills=4))


def scores(pairs):
    """Recall and precision by kind; a span is right if one of its kind overlaps it."""
    hit, gold, true, found = ({k: 0 for k in labelled.KINDS.values()} for _ in range(4))
    meet = lambda a, b: a[2] == b[2] and a[0] < b[1] and b[0] < a[1]
    for right, got in pairs:
        for x in right:
            gold[x[2]] += 1
            hit[x[2]] += any(meet(x, y) for y in got)
        for x in got:
            found[x[2]] += 1
            true[x[2]] += any(meet(x, y) for y in right)
    return {k: (hit[k] / gold[k], true[k] / found[k]) for k in gold}


def test_held_out_lines():
    """Trained without every fifth line of the table, measured on those, in other values: whole sentences are new."""
    pairs = []
    for fold in range(2):
        held = [x for i, x in enumerate(labelled.LINES) if i % 5 == fold]
        rest = [x for i, x in enumerate(labelled.LINES) if i % 5 != fold]
        rows = labelled.examples(6, 99, held, strange=(0.0,))
        seen = cases_of([t for t, _ in rows] + [t for t, _ in labelled.examples(6, 11, rest)])
        finder = Finder(train(seen, 8, 11, rest))
        pairs += [(spans, got) for (_, spans), got in zip(rows, finder([t for t, _ in rows]))]
    found = scores(pairs)
    for kind, (recall, precision) in found.items():
        assert recall >= 0.85 and precision >= 0.9, (kind, recall, precision)
    assert sum(r for r, _ in found.values()) / len(found) >= 0.9


#: Sentences that no line of the table resembles, with the one kind they hold, or none.
OTHERS = [
    ("Her social security number is 219-09-9999.", "identity_number"),
    ("His passport number is K4455667 and it has expired.", "identity_number"),
    ("National ID 12345678Z was rejected.", "identity_number"),
    ("The engine was inspected by Maureen Oduya before the flight.", "person_name"),
    ("We asked Dr. Lang for his view.", "person_name"),
    ("The student, Alicia Moreno, landed safely.", "person_name"),
    ("Le témoin, Gérard Lefort, est parti.", "person_name"),
    ("You can phone me at 415-555-0199 any time.", "phone"),
    ("The office line is +44 20 7946 0958 during the week.", "phone"),
    ("Her address is 12 Rosewood Close, Derby.", "street_address"),
    ("We met at 4500 Wilshire Boulevard last night.", "street_address"),
    ("Il habite 14 rue Pasteur.", "street_address"),
    ("Write to bob_smith@aol.com for the files.", "email"),
    ("The approach plate for Denver International was revised.", None),
    ("Boeing 737 aircraft may not use runway 09L.", None),
    ("Contact Ground on 121.900 and hold short of Charlie.", None),
    ("Fly over LFX@23.8 and continue.", None),
    ("I saw Harold Finch walking along the fence.", "person_name"),
    ("Captain Reyes declared an emergency at 1200.", "person_name"),
    ("If you see Petra Novak, tell her the chart is ready.", "person_name"),
    ("Yesterday, Thomas Becker resigned.", "person_name"),
    ("Mail: j.doe@somewhere.org", "email"),
    ("Llame al 612 345 678 hoy.", "phone"),
    ("My licence, number 88213344, was left in the cockpit.", "identity_number"),
    ("The NOTAM for Cedar Rapids expires in May.", None),
]


def test_sentences_of_another_hand(finder):
    found = [{k for _, _, k in spans} for spans in finder([t for t, _ in OTHERS])]
    wrong = [t for (t, kind), got in zip(OTHERS, found) if kind and kind not in got]
    assert len(wrong) <= 0.2 * sum(bool(kind) for _, kind in OTHERS)
    assert not [t for (t, kind), got in zip(OTHERS, found) if not kind and got]


def test_viterbi_finds_the_best_path():
    r = random.Random(3)
    chain = Chain(["O", "B-x", "I-x"], lambda t: [t])
    chain.fit([["a", "b", "c"], ["c", "a"], ["b"]] * 3, [["O", "B-x", "I-x"], ["O", "O"], ["B-x"]] * 3)
    import itertools

    import numpy as np

    for _ in range(20):
        row = [r.choice("abc") for _ in range(r.randint(1, 5))]
        scores_ = chain.token_scores(["a", "b", "c"])
        numbers = np.array(["abc".index(x) for x in row])
        emission = chain.emissions(scores_, numbers[None])[0]
        value = lambda path: chain.first[path[0]] + sum(chain.step[a, b] for a, b in zip(path, path[1:])) + sum(emission[i, y] for i, y in enumerate(path))
        best = max(itertools.product(range(3), repeat=len(row)), key=value)
        assert value(tuple(chain.decode([numbers], scores_)[0])) == pytest.approx(value(best))


def test_redaction_and_tokens():
    assert redact("call 555 now", [(5, 8, "phone")]) == "call [PHONE] now"
    assert tokens_of("a-b c.d, e") == (["a-b", "c.d", ",", "e"], [(0, 3), (4, 7), (7, 8), (9, 10)])


TEXTS = ["Near Old Fenwick Ridge, near Old Fenwick Ridge. ANNA saw Anna and anna.", "At Vesper Bay (at Vesper) d'Or co-op X 9th", "from Oslo\nOslo, Oslo from Oslo", ""] * 3


def test_cases_of_the_corpus_equal_plain_counting(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    counts = count_cases(TEXTS)
    assert corpus_cases(df, "text", 1e-3) == {w: case_profile(*n) for w, n in counts.items() if sum(n[:3]) >= 3}
    assert counts["fenwick"][3] == counts["ridge"][3] == 6 and counts["bay"][3] == 3 and counts["anna"] == [3, 3, 3, 0]


def test_find_personal(spark):
    rows = [(1, "Signed: Anna Bergstrom. Write to anna.b@mailbox.example, please.", "x"), (2, None, "x"), (3, "", "x"), (1, "Signed: Anna Bergstrom. Write to anna.b@mailbox.example, please.", "y"), (4, "Nothing here. " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    chain = tagger(df, fills=2)
    assert tagger(df, fills=2) is chain
    out = sorted(find_personal(df, "doc_id", chain=chain).collect())
    assert len(out) == 5 and [r.doc_id for r in out] == [1, 1, 2, 3, 4]
    assert out[0].redacted == "Signed: [NAME]. Write to [EMAIL], please." and out[0].kinds == ["email", "person_name"] and out[0] == out[1]
    assert (out[2].redacted, out[2].kinds) == ("", []) and (out[3].redacted, out[3].kinds) == ("", [])
    assert out[4].redacted == rows[4][1] and out[4].kinds == []
    assert find_personal(df.where("false"), "doc_id", chain=chain).count() == 0
    assert CASE_SHARE == 5e-6
