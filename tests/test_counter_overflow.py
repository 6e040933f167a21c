import random

from keyloom.operators import objects as O

TOP = 2**63 - 1


def test_refused_increments_leave_the_counter(spark):
    rng = random.Random(3)
    deltas = [TOP, 1, -5, 4, 2, -TOP, -TOP, -3, -(2**63), 7, None, 0]
    rows = [(k, i, rng.choice(deltas)) for i, k in enumerate(rng.choices(["a", "b", None], k=300))]
    rows += [("small", 1000 + i, rng.randint(-9, 9)) for i in range(50)] + [("edge", 2000, TOP), ("edge", 2001, -(2**63))]
    want, state = {}, {}
    for k, seq, by in rows:
        old = state.get(k, 0)
        refused = by is not None and not -(2**63) <= old + by <= TOP
        state[k] = old if refused else old + (by or 0)
        want[seq] = (None if by is None else old, state[k], refused)
    assert sum(r for _, _, r in want.values()) > 10
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, q bigint, d bigint")
    assert {r.q: (r.before, r.after, r.overflow) for r in O.counter_log(df, "k", "d", "q").collect()} == want
    last = {r.k: (r.value, r.overflow) for r in O.counters(df, "k", "d", "q").collect()}
    assert last == {k: (v, any(want[s][2] for kk, s, _ in rows if kk == k)) for k, v in state.items()}
