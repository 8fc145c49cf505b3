import hashlib
import math
import random
import re
from collections import Counter

from tamarack.llm import secrets

PATTERNS = [
    (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    found = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))
    return found, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_base_matches_are_those_of_the_patterns(documents):
    rng = random.Random(2)
    bits = ["password=", "Secret: ", "api_key'= \"", "API-KEY=", "token", " = ", "abcdef0123456789", "AKIA", "QWERTY123456", "é😀", "\n", "short", "deadbeef" * 4, "x", "password=token=abcdefgh", "f" * 31, "AKIAAKIA1234"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "😀 password=hunter2hunter2"), (None, "token: abcdefgh"), (1003, "z " * 40_000 + "token=" + "a" * 5000)]
    texts = dict(rows)
    out = secrets.scan(documents(rows, extra=True)).collect()
    assert len(out) == len(rows)
    for r in out:
        found, said = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in found) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in said.split(",") if x]


def test_model_tells_random_strings_from_words(documents):
    rng = random.Random(9)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rng.choice(chars) for _ in range(40)) + " there") for i in range(50)]
    words = ["ThisIsAnOrdinaryClassNameInJava", "some_function_name_with_many_parts", "https/www/example/com/index/html", "internationalizationofsoftware", "----------------------------", "Geschwindigkeitsbegrenzungen", "CONSTANT_NAME_FOR_THE_DEFAULT"]
    rows += [(100 + i, f"see {w} there") for i, w in enumerate(words)]
    out = {r.doc_id: r.spans for r in secrets.scan(documents(rows)).collect()}
    assert sum(out[i] == "random:4:44" for i in range(50)) >= 48
    assert [out[100 + i] for i in range(len(words))] == [""] * len(words)


def runs(text):
    """The model's spans, scored pair by pair in Python from counts of the samples."""
    symbols = {**{c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}, **dict.fromkeys("0123456789", 52), **dict.fromkeys("+/=", 53), "_": 54, "-": 55}
    logs = []
    for sample in secrets.samples():
        pairs, first, every = Counter(), Counter(), Counter()
        for t in sample:
            for a, b in zip(t, t[1:]):  # noqa: B905
                pairs[symbols[a], symbols[b]] += 1
                first[symbols[a]] += 1
                every[symbols[b]] += 1
        total = sum(every.values()) + 0.5 * 56 * 56
        logs.append(lambda a, b, p=pairs, f=first, e=every, t=total: math.log((p[a, b] + 0.5 + 30 * (e[b] + 28) / t) / (f[a] + 28 + 30)))
    held, out = base(text)[0], []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text or ""):
        s = [symbols[c] for c in m[0]]
        ratio = sum(logs[0](a, b) - logs[1](a, b) for a, b in zip(s, s[1:]))  # noqa: B905
        if ratio >= secrets.LEAST and ratio >= secrets.LEAST_EACH * (len(s) - 1) and not any(a < m.end() and m.start() < b for a, _, b in held):
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def test_scores_are_those_of_the_plain_model(documents):
    rng = random.Random(21)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
    parts = lambda: rng.choice(["".join(rng.choice(chars) for _ in range(rng.randint(15, 45))), "_".join(rng.choice(secrets._WORDS) for _ in range(5)), "token=" + "".join(rng.choice(chars) for _ in range(30)), "é", "0" * 40, "A" * 25])
    rows = [(i, " ".join(parts() for _ in range(rng.randint(1, 8)))) for i in range(200)]
    out = {r.doc_id: r for r in secrets.scan(documents(rows)).collect()}
    assert sum(r.n_random for r in out.values()) > 100
    for i, t in rows:
        assert [x for x in out[i].spans.split(",") if x.startswith("random")] == runs(t)
        assert out[i].n_random == len(runs(t))


def test_a_text_of_many_matches(documents):
    text = "token=abcdefgh12 " * 20_000
    row = secrets.scan(documents([(1, text)])).first()
    assert row.n_assign == 20_000 and row.base_sha256 == hashlib.sha256(base(text)[1].encode()).hexdigest()


def test_plan_has_no_python(documents):
    plan = secrets.scan(documents([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert secrets.scan(documents([])).count() == 0
