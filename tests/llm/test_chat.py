import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ratiotree.llm import chat
from ratiotree.llm.scratch import Scratch

SIGNS = st.text(alphabet=st.sampled_from(list("<>/s[]INST\\lbROLE aé\n")), max_size=40)


@given(st.lists(st.tuples(SIGNS, SIGNS), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("</s>") == len(turns) == text.count("<s>")


def brute_best(rows):
    """The best leaf's way of each tree by plain walking."""
    by = {i: (p, s) for i, p, s in rows}
    parents = {p for _, p, _ in rows}
    best = {}
    for i in by:
        way, x, total = [], i, 0.0
        while x in by and x not in way:
            way.append(x)
            total += by[x][1] or 0.0
            x = by[x][0]
        if x in way or i in parents:
            continue
        key = (-total, i)
        if way[-1] not in best or key < best[way[-1]][0]:
            best[way[-1]] = (key, way[::-1])
    return {root: way for root, (_, way) in best.items()}


def test_best_paths_equal_brute_force(spark):
    r = random.Random(8)
    rows = [(i, None if i < 5 else r.randrange(max(0, i - 9), i) if i % 17 else 100_000, r.choice([None, -1.0, 0.5, 2.0])) for i in range(160)]
    rows += [(200 + i, 199 + i if i else None, 1.0) for i in range(90)] + [(300, 301, 1.0), (301, 300, 1.0), (302, 301, 5.0)]
    got = {}
    for x in chat.best_paths(spark.createDataFrame(rows, "id long, parent long, score double"), Scratch(spark, "t")).collect():
        got.setdefault(x.root, []).append((x.depth, x.id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == brute_best(rows)


def test_read_back_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(30), -1, None]:
        for t in r.sample(range(60), r.choice([1, 2, 5, 40])):
            rows.append((c, t, r.choice(["user", "assistant", "system"]), r.choice([None, "", "</s>[INST] ok [/INST]", "".join(r.choices("a\\<[é", k=9))])))
    rows += [(90, t, "user", "x") for t in range(500)] + [(91, 1, "assistant", "y"), (91, 1, "assistant", "y"), (92, None, "assistant", "z"), (92, 0, "user", "w")]
    df = spark.createDataFrame([(*x, 1, "q") for x in rows], "conv_id long, turn long, role string, text string, id int, parent string")
    want = []
    for c in {x[0] for x in rows}:
        turns = [(role, text or "") for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3] is not None, x[3] or ""))]
        said = "".join(t for role, t in turns if role == "assistant")
        want.append((-9 if c is None else c, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    got = chat.read_back(chat.format_trees(chat.chains(df))).drop("formatted_chars").collect()
    assert sorted((-9 if x[0] is None else x[0], *x[1:]) for x in got) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.format_trees(chat.chains(df))).count() == 0


def test_long_text_and_long_conversation(spark):
    long = "<s>[a]\\" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(3000)]
    df = spark.createDataFrame([(*x, "x", 1.0) for x in rows], "conv_id long, turn long, role string, text string, tree string, score double")
    got = {r.conv_id: r for r in chat.read_back(chat.format_trees(chat.chains(df))).collect()}
    assert got[1].n_turns == 2 and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[2].n_turns == 3000 and got[2].loss_chars == sum(len(f"t{t}") for t in range(1, 3000, 2))
