import hashlib
import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from skyloom.llm import secrets

from .data import ODD, frame, put

PATTERNS = [
    ("assign", re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return [f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(spans)]


def texts():
    rng = random.Random(1)
    parts = ["token", "API_key", "apikey", "Secret", "passwd", "password", ": ", "=", " = ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "é🎉", " ", "\n", "deadbeef" * 4, "0123abcd", "x=y", "Ab1.", "longvalue99", "secret=token=abcdefgh", 'secret: "token" = "longvalue1"', "ſecret=abcdefghij"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    return out + ODD + ["x" * 90_000 + " token = 'abcdefgh1' " + "f" * 40]


def test_base_matches_brute_force(spark, tmp_path):
    rows = texts()
    got = {r.doc_id: r for r in secrets.op6_secret_scan(spark, put(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(got[i].spans.split(",")) or not want


def test_battery_tells_random_tokens_from_words(spark):
    rng = random.Random(2)
    b64 = string.ascii_letters + string.digits + "+/"
    good = ["key " + "".join(rng.choice(b64) for _ in range(n)) + "a1b2 end" for n in (32, 40, 64) for _ in range(20)]
    plain = ["see " + "chapter1section2paragraph3" * 2 + " end", "id " + "0000000000111111111122zzzzzzzzzz33zz" + " end", "xxxx1111" * 6] * 20
    found = secrets.scan(frame(spark, good + plain)).orderBy("doc_id").collect()
    hits = [bool(r.spans) for r in found]
    assert sum(hits[:60]) >= 57
    assert sum(hits[60:]) == 0


ALPHABETS = {"hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters}
WORDS = "information between government international development university environment community department association organization understanding communication administration responsibility characteristics representative the of and user order file name test value index page report".split()


def test_planted_tokens_are_found_among_ordinary_ones(spark):
    """Recall of random tokens of each encoding at least 0.9; of what is reported, at most a tenth ordinary."""
    rng = random.Random(11)
    random_tokens = [(name, n, "".join(rng.choice(chars) for _ in range(n))) for name, chars in ALPHABETS.items() for n in (20, 24, 32, 48, 64) for _ in range(30)]
    ordinary = []
    while len(ordinary) < 1500:
        some = [rng.choice(WORDS) for _ in range(rng.randint(3, 8))]
        t = rng.choice([lambda x: "_".join(x), lambda x: "-".join(x).upper(), lambda x: "".join(w.title() for w in x), lambda x: "/".join(x) + f"/{rng.randrange(2030)}", lambda x: "".join(x), lambda x: str(rng.randrange(10**25)).zfill(25)])(some)
        if len(t) >= 20:
            ordinary.append(t)
    rows = [("r", f"see {t} end") for _, _, t in random_tokens] + [("o", f"see {t} end") for t in ordinary]
    got = {r.doc_id: secrets_of(r.spans) for r in secrets.scan(frame(spark, [t for _, t in rows])).collect()}
    hit = [bool(got[i]) for i in range(len(rows))]
    wrong, right = sum(hit[len(random_tokens) :]), sum(hit[: len(random_tokens)])
    assert wrong <= 0.1 * (wrong + right), (wrong, right)
    assert right >= 0.9 * len(random_tokens), right
    for name in ALPHABETS:
        mine = [h for h, (x, _, _) in zip(hit, random_tokens) if x == name]
        assert sum(mine) >= 0.9 * len(mine), (name, sum(mine), len(mine))


LANGUAGES = (
    WORDS,
    "donau dampfschiff fahrt gesellschaft kapitaen rechtsschutz versicherung kraftfahrzeug haftpflicht arbeits unfaehigkeit bescheinigung geschwindigkeit begrenzung lebens mittel wirtschaft bundes verfassung gericht".split(),
    "gouvernement constitution administration developpement environnement universite responsabilite communication representant organisation".split(),
    "administracion constitucionalmente responsabilidad universidad comunicaciones internacionalizacion desarrollo departamento representante".split(),
)


def test_recall_and_false_share_by_length_class(spark):
    """Every length class by itself, its shortest lengths too; ordinary tokens are compounds, paths and identifiers in four languages."""
    rng = random.Random(5)
    planted = [(name, n, "".join(rng.choice(chars) for _ in range(n))) for name, chars in ALPHABETS.items() for n in (20, 21, 22, 23, 24, 27, 31, 32, 40, 63, 64, 100) for _ in range(40)]
    makers = [lambda x: "".join(x).capitalize(), "_".join, "-".join, lambda x: "".join(w.title() for w in x), lambda x: "/".join(["usr", "lib", *x]) + f"/v{rng.randrange(9)}", lambda x: x[0] + "".join(w.title() for w in x[1:]) + str(rng.randrange(100))]
    ordinary = []
    while len(ordinary) < 3000:
        language = rng.choice(LANGUAGES)
        t = rng.choice(makers)([rng.choice(language) for _ in range(rng.randint(2, 6))])
        ordinary += [t] if len(t) >= 20 else []
    tokens = [t for _, _, t in planted] + ordinary
    got = {r.doc_id: bool(secrets_of(r.spans)) for r in secrets.scan(frame(spark, [f"see {t} end" for t in tokens])).collect()}
    of = lambda n: sum(n >= c for c in secrets.CLASSES[1:])
    for c in range(len(secrets.CLASSES)):
        right = [got[i] for i, (_, n, _) in enumerate(planted) if of(n) == c]
        wrong = sum(got[len(planted) + i] for i, t in enumerate(ordinary) if of(len(t)) == c)
        assert sum(right) >= 0.9 * len(right), (c, sum(right), len(right))
        assert wrong <= secrets.LEVEL * (wrong + sum(right)), (c, wrong, sum(right))
        for name in ALPHABETS:
            mine = [got[i] for i, (x, n, _) in enumerate(planted) if x == name and of(n) == c]
            assert sum(mine) >= 0.8 * len(mine), (c, name)
    shortest = [got[i] for i, (_, n, _) in enumerate(planted) if n < 24]
    assert sum(shortest) >= 0.9 * len(shortest)


def secrets_of(spans):
    return [s for s in spans if s.kind == secrets.KINDS["random"]]


def brute_battery(token):
    body = token.rstrip("=")
    upper, lower, digit = string.ascii_uppercase, string.ascii_lowercase, string.digits
    kinds = [("[0-9a-f]+|[0-9A-F]+", digit + "abcdef"), ("[A-Z2-7]+", upper + "234567"), ("[A-Za-z0-9]+", upper + lower + digit), ("[A-Za-z0-9+/_-]+", upper + lower + digit + "+/")]
    alphabet = next(a for p, a in kinds if re.fullmatch(p, body))
    k, n = len(alphabet), len(body)
    v = [alphabet.index(c) for c in (body.lower() if k == 16 else body.replace("_", "/").replace("-", "+"))]
    mean, var = (k - 1) / 2, (k * k - 1) / 12
    chi = (sum(x * x for x in Counter(v).values()) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
    runs = (sum((a > mean) != (b > mean) for a, b in zip(v, v[1:])) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / (var * math.sqrt(n - 1))
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    p = min(1, 3 * min(0.5 * math.erfc(chi / math.sqrt(2)), two(runs), two(lag)))
    shares = [x / sum(secrets.LETTER_SHARES) for x in secrets.LETTER_SHARES]
    logs = []
    for u, w, d, s in secrets.STYLES:
        q = {c: u * x for c, x in zip(upper, shares)} | {c: w * x for c, x in zip(lower, shares)} | dict.fromkeys(digit, d / 10) | dict.fromkeys("+/", s / 2)
        logs.append(math.prod(q[c] * k for c in body.replace("_", "/").replace("-", "+")))
    return p, min(1, sum(logs) / len(logs))


def test_statistics_and_cut_equal_brute_force(spark):
    rng = random.Random(12)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(20, 70))) for a in ALPHABETS.values() for _ in range(25)]
    tokens += ["_".join(rng.choice(WORDS) for _ in range(4)) + "_long" for _ in range(60)] + ["a" * 30, "-" * 25, "abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = df.select(secrets.p_value(F.col("t")).alias("p"), secrets.ordinary_p(F.col("t")).alias("q")).collect()
    want = [brute_battery(t) for t in tokens]
    for g, (p, q), t in zip(got, want, tokens):
        assert abs(g.p - p) < 1e-5 and math.isclose(g.q, q, rel_tol=1e-6, abs_tol=1e-250), t
    p = [1.0 if q <= secrets.LEVEL and p < secrets.BATTERY_LEVEL else q for p, q in want]
    bins = [min(math.floor(-math.log10(max(x, 1e-300)) * 10), 1000) for x in p]
    classes = [sum(len(t) >= c for c in secrets.CLASSES[1:]) for t in tokens]
    cut = {}
    for c in set(classes):
        mine = [b for b, k in zip(bins, classes) if k == c]
        cut[c] = min((b for b in set(mine) if len(mine) * 10 ** (-b / 10) <= secrets.LEVEL * sum(x >= b for x in mine)), default=1001)
    rows = secrets.scan(frame(spark, [f"see {t} end" for t in tokens])).orderBy("doc_id").collect()
    clear = [i for i, r in enumerate(rows) if not r.base]
    # a base span takes its token out of the counts; none is among these but for lower-case hex
    assert len(clear) == len(rows)
    assert [bool(secrets_of(r.spans)) for r in rows] == [b >= cut[c] for b, c in zip(bins, classes)]


def test_empty_table(spark):
    assert secrets.scan(frame(spark, [])).count() == 0
