import random
from math import ceil

from daygrain.llm import licenses
from test_words import words
from cases import ODD


def brute(text, templates, containment):
    w, best = words(text), {}
    for label, wording in templates:
        t, stride = set(wording.split()), licenses.stride_of(len(wording.split()))
        for at in range(0, len(w), stride):
            common = len(t & set(w[at:at + 2 * stride]))
            if common >= ceil(containment * len(t) - 1e-9):
                best[label] = max(best.get(label, 0), common / len(t))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        q = phrase.split()
        found = [a for a in range(len(w) - len(q) + 1) if w[a:a + len(q)] == q]
        places += found
        labels |= {label} if found else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels), sorted(labels | set(best)),
            1.0 if places else max(best.values(), default=0.0))


def test_scan_matches_brute_force(frame):
    rng = random.Random(4)
    vocabulary = ["the", "of", "license", "under", "MIT", "cc", "by", "nc", "Version", "2", "é", "apache", "rights", "K"]
    docs = list(ODD)
    for i in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            notice = rng.choice(licenses.TEMPLATES)[1].upper().split()
            if i % 2:
                notice.pop(rng.randrange(len(notice)))
            rng.shuffle(notice) if i % 5 == 0 else None
            at = rng.randint(0, len(text))
            text[at:at] = notice
        if i % 4 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(["under - the\nMIT  License", "Apache License, Version 2.0", "CC BY-NC", "cc by ncx", "subunder the mit license"]).split(" ")
        docs.append((100 + i, rng.choice([" ", "\n", ", "]).join(text)))
    got = licenses.scan(frame(docs)).collect()
    want = sorted(((i, *brute(t, licenses.TEMPLATES, licenses.CONTAINMENT)) for i, t in docs), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(r["n_base"] > 1 for r in got) and any(set(r["labels"]) - set(r["base_labels"]) for r in got)


def test_long_templates(frame):
    """A document that quotes a template is found whatever the template's length and place."""
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    templates = [*licenses.TEMPLATES, ("sixty", " ".join(say(60))), ("long", " ".join(say(300))), ("edge", " ".join(say(48))), ("empty", "")]
    assert [licenses.stride_of(n) for n in (1, 24, 25, 48, 49, 60, 300)] == [24, 24, 48, 48, 96, 96, 384]
    docs, quoted = [], {}
    for i in range(60):
        label, wording = templates[-2 - i % 3]
        text = wording.split()
        if i % 2:
            text = [w for w in text if rng.random() > 0.05]
        else:
            quoted[i] = label
        docs.append((i, " ".join(say(rng.randint(0, 200)) + text + say(rng.randint(0, 200)))))
    docs += [(100 + i, " ".join(say(i * 5))) for i in range(40)] + [(200, templates[-3][1]), (201, templates[9][1])]
    got = {r["id"]: r for r in licenses.scan(frame(docs), templates=templates).collect()}
    for i, text in docs:
        want = brute(text, templates[:-1], licenses.CONTAINMENT)
        assert (got[i]["labels"], got[i]["score"]) == (want[5], want[6])
    assert all(label in got[i]["labels"] for i, label in quoted.items())
    assert licenses.scan(frame(docs), templates=[("empty", "")]).agg({"score": "max"}).first()[0] == 0.0


def test_same_id_other_text_and_empty(frame, empty):
    got = licenses.scan(frame([(1, "All rights reserved."), (1, "nothing"), (1, "All rights reserved.")])).collect()
    assert sorted(r["labels"] for r in got) == [[], ["all-rights-reserved"], ["all-rights-reserved"]]
    assert licenses.scan(empty).count() == 0


def test_native(frame):
    plan = licenses.scan(frame([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_split_once(frame):
    """The test for rare words and the blocks share one split of a text, in every class of template lengths."""
    templates = [licenses.TEMPLATES[0], ("long", " ".join(f"w{i}" for i in range(60)))]
    for asked, classes in ((licenses.TEMPLATES, 1), (templates, 2)):
        plan = licenses.template_matches(frame([(1, "x")]), templates=asked)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == classes


def test_phrases_begin_in_any_case(frame):
    phrases = {"under the mit license": "a", "9 lives": "b", "été du": "c"}
    docs = [(1, "UNDER the mit-license"), (2, "Under\nThe MIT license, 9 lives"), (3, "19 lives; été du, sous été du"), (4, "xunder the mit license")]
    got = {r["id"]: (r["n_base"], r["first_word"], r["last_word"]) for r in licenses.scan(frame(docs), phrases=phrases, templates=()).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 0, 4), 3: (2, 2, 5), 4: (0, None, None)}
