import hashlib
import random
import re
import string
from collections import Counter

from tidewater.llm import secrets
from tidewater.llm.queries import secret_digest


def slow_spans(text):
    out = []
    for k, (kind, pattern, least, group) in enumerate((
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0),
        ("hex", r"[0-9a-f]+", 32, 0),
    )):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def make(rng, kind):
    if kind == "hex":
        return "".join(rng.choices("0123456789abcdef", k=40))
    return "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))


def test_base_against_plain_patterns(spark):
    rng = random.Random(4)
    texts = [None, "", "é token = abcdefgh", "secret: token = abcdefghij", "ſecret=abcdefgh", "PASSWORD:'x" * 3, "token=" + "a" * 31 + "\U0001f600" + "f" * 32]
    for _ in range(200):
        parts = [rng.choice(["token", "API_KEY", "passwd", " ", '"', "=", ":", make(rng, "hex")[: rng.randrange(25, 41)], make(rng, "access")[: rng.randrange(10, 21)], "wörd"]) for _ in range(rng.randrange(12))]
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' AS spans")
    got = {r.doc_id: r for r in secret_digest(secrets.find_secrets(df)).collect()}
    for i, t in enumerate(texts):
        base = slow_spans(t or "")
        counts = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[i].spans.split(",")) or not base


def test_automata_add_the_formats_they_learnt(spark):
    rng = random.Random(5)
    syllables = ["ther", "and", "ing", "tion", "ou", "en"]
    plain = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 7))) for _ in range(n))
    rows = [(i, f"{plain(30)} token={make(rng, 'hex')} {plain(20)} {make(rng, 'access')}") for i in range(300)]
    rows += [(1000, f"{plain(5)} ASIA{make(rng, 'access')[4:]} {plain(3)}"), (1001, plain(200)), (1002, f"part-of-the-road-{1999} {plain(4)} mailing-list-2020-for-ther")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_digest(secrets.find_secrets(df)).collect()}
    assert got[1000].n_format == 1 and got[1000].spans.startswith("format:")
    assert got[1001].n_format == 0 and got[1002].n_format == 0
    assert sum(r.n_format for r in got.values()) == 1


def test_merging_generalises():
    rng = random.Random(6)
    automaton = secrets.Automaton(Counter(make(rng, "hex") for _ in range(500)))
    tree = len({v[:i] for v in (make(rng, "hex") for _ in range(500)) for i in range(41)})
    reached, todo = {0}, [0]
    while todo:
        for t in automaton.next[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    assert len(reached) < tree / 20
    fresh = automaton.score(make(rng, "hex"))
    assert fresh > automaton.score("understanding-of-the-other-tokens") + 0.5


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(empty).collect() == []


def test_letters_alone_digits_alone_and_short_values_are_scored():
    rng = random.Random(7)
    keys = Counter("".join(rng.choices("QXZJKVWY", k=12)) for _ in range(400))
    pins = Counter("".join(rng.choices("0123456789", k=14)) for _ in range(400))
    words = Counter("".join(rng.choices(["ther", "and", "ing", "tion", "ou", "en"], k=rng.randrange(2, 6))) for _ in range(600))
    automata = {"assign": secrets.Automaton(keys), "access": secrets.Automaton(pins), "ordinary": secrets.Automaton(Counter(w for w in words if len(w) >= 8))}
    text = "therandingou QXZJKVWYQXZJ tionandther 20481357901234 ".replace("  ", " ")
    _, more = secrets.scan_text(text * 2, automata)
    assert [text[s % len(text) : (s % len(text)) + e - s] for s, e, _, _ in more] == ["QXZJKVWYQXZJ", "20481357901234"] * 2


def test_small_tables_that_all_hold_credentials_learn_ordinary_tokens(spark):
    rng = random.Random(8)
    key = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=24))
    word = lambda: "".join(rng.choices(["ther", "and", "ing", "tion", "ou", "en"], k=rng.randrange(3, 6)))
    rows = [(i, f"{word()} {word()} {word()} {word()} token={key()} ") for i in range(40)]
    rows += [(100, f"see {key()} "), (101, f"see {key()} "), (101, "x" * 3_000_000), (102, "token=" + "xy1" * 400_000)]
    found = {r.id: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).where("id <> 101 OR size(spans) > 0").collect()}
    assert [s.kind for s in found[100].spans] == ["format"] and [s.kind for s in found[101].spans] == ["format"]
    assert [(s.kind, s.end) for s in found[102].spans] == [("assign", 6 + 1_200_000)]


def test_held_out_credentials_without_their_keyword(spark):
    """Formats learnt from assignments are found where no keyword stands, in ten thousand texts; ordinary texts are left alone."""
    rng = random.Random(12)
    alnum, low = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    makers = {"prefixed": lambda: "tk_live_" + pick(alnum, 24), "encoded": lambda: pick(alnum + "+/", 38) + "==", "dotted": lambda: f"{pick(low, 10)}.{pick(low, 12)}.{pick(alnum, 20)}"}
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    rows, planted = dict(docs), {}
    chosen = rng.sample(sorted(rows), 360)
    for n, i in enumerate(chosen):
        kind = sorted(makers)[n % 3]
        value = makers[kind]()
        words = rows[i].split(" ")
        at = rng.randrange(len(words) + 1)
        if n < 180:  # learnt from
            words.insert(at, f'password = "{value}"')
        else:
            words.insert(at, value)
            planted[i] = (kind, value)
        rows[i] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(8)
    found, false = Counter(), []
    for r in secrets.find_secrets(df).collect():
        for s in r.spans:
            if s.kind == "format":
                text = rows[r.id][s.start : s.end]
                if r.id in planted and (text in planted[r.id][1] or planted[r.id][1] in text):
                    found[planted[r.id][0]] += 1
                else:
                    false.append(text)
    assert all(found[k] >= 48 for k in makers), found  # of 60 each
    assert len(false) <= 3, false
