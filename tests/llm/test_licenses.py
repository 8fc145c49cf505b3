import math
import random
import re

from tamarack.llm import licenses


def test_licenses_are_found_where_they_stand(documents):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"][0]
    fill = "some words that mean little in this place " * 30
    rows = [
        (1, f"{fill}\n{mit[0]}.\n{fill}"), (2, mit[2].upper()), (3, fill), (4, None), (5, ""), (6, f"{gpl} {fill} {mit[0]}"),
        (7, "licensed"), (8, "We released under the bridge a license of some kind."), (8, mit[0]), (None, mit[1]), (9, fill * 40 + mit[0] + " " + fill * 40),
    ]
    out = {(r.doc_id, r.license) for r in licenses.scan(documents(rows, extra=True)).collect()}
    assert {x for x in out if x[1] in ("MIT", "GPL-3.0")} == {(1, "MIT"), (2, "MIT"), (6, "GPL-3.0"), (6, "MIT"), (8, "MIT"), (None, "MIT"), (9, "MIT")}
    assert not {3, 4, 5, 7} & {i for i, _ in out}


def test_every_template_is_found_at_every_place(documents):
    texts = [(name, t) for name, all_ in licenses.TEMPLATES.items() for t in all_]
    rows = [(10 * i + k, "w " * k + t + " v" * (7 - k)) for i, (_, t) in enumerate(texts) for k in range(7)]
    out = {(r.doc_id, r.license): r for r in licenses.scan(documents(rows)).collect()}
    for i, (name, _) in enumerate(texts):
        for k in range(7):
            assert out[10 * i + k, name].containment == 1.0


def test_containment_against_brute_force(documents):
    words = licenses._split(licenses.TEMPLATES["MIT"][2])
    rows = []
    for i in range(len(words)):
        rows.append((i, " ".join(words[:i] + ["other"] + words[i + 1 :])))
    got = {r.doc_id for r in licenses.scan(documents(rows)).where("license = 'MIT'").collect()}
    grams = set(licenses._grams(words))
    assert got == {i for i, t in rows if len(grams & set(licenses._grams(t.split()))) >= licenses.CONTAINED * len(grams)}


def plain(text):
    """{license: largest containment in a window}, by looking at every window of every template."""
    out, words = {}, licenses._split(text or "")
    for name, texts in licenses.TEMPLATES.items():
        for t in map(licenses._split, texts):
            width = math.ceil(1.25 * len(t))
            grams, k = set(licenses._grams(t)), min(licenses.SHINGLE, len(t))
            for at in range(0, max(len(words) - len(t), 0) + 1, width - len(t) + 1):
                part = words[at : at + width]
                own = {" ".join(part[i : i + k]) for i in range(len(part) - k + 1)}
                share = len(own & grams) / len(grams)
                if share >= licenses.CONTAINED:
                    out[name] = max(out.get(name, 0), share)
    return out


def test_all_templates_against_all_windows(documents):
    """Templates with words dropped, changed and put in between other words."""
    rng = random.Random(3)
    rows = []
    for name in licenses.TEMPLATES:
        for t in licenses.TEMPLATES[name]:
            for _ in range(8):
                words = t.split()
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    i = rng.randrange(len(words))
                    words[i : i + rng.randint(0, 1)] = [rng.choice(["license", "the", "other"])]
                fill = lambda: [rng.choice("the software of any license is under this and rights".split()) for _ in range(rng.randint(0, 12))]
                rows.append((len(rows), " ".join(fill() + words + fill())))
    got = {}
    for r in licenses.scan(documents(rows)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    want = {i: p for i, t in rows if (p := plain(t))}
    assert len(want) > 100 and got == want


def test_plan_has_no_python_and_empty_table(documents):
    plan = licenses.scan(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert licenses.scan(documents([])).count() == 0
