"""Exact sums, and the fold of a card in time proportional to its rows."""

import math
import random
import time
from collections import deque

from txguard.operators.exact import ExactSum
from txguard.plans import banking


def test_sums_equal_the_rounded_true_sum():
    rng = random.Random(0)
    kept, total = deque(), ExactSum()
    for _ in range(3000):
        x = rng.choice([rng.uniform(-1e6, 1e6), 0.1, 1e300, -1e300, 5e-324, round(rng.uniform(0, 500), 2)])
        kept.append(x)
        total.add(x)
        if rng.random() < 0.4:
            total.add(kept.popleft(), -1)
        assert total.value() == math.fsum(kept)


def test_values_that_are_no_numbers_leave_with_their_terms():
    total = ExactSum()
    for x in (1.5, math.inf):
        total.add(x)
    assert total.value() == math.inf
    total.add(-math.inf)
    assert math.isnan(total.value())
    for x in (math.inf, -math.inf):
        total.add(x, -1)
    assert total.value() == 1.5
    total.add(math.nan)
    assert math.isnan(total.value()) and total.plus(total, -1).value() == 0.0
    huge = ExactSum()
    huge.add(1.7e308)
    huge.add(1.7e308)
    assert huge.value() == math.inf


def run(step, n, spread_ms):
    rng = random.Random(1)
    amounts = [round(rng.uniform(1, 400), 2) for _ in range(n)]
    out = []
    for i, amount in enumerate(amounts):
        ts = i * spread_ms // n
        out.append(step(ts, f"t{i}", "c", amount, f"m{i % 7}", f"r{i % 3}", "d", "m", 1e9, 1e9, 1e9, None, None, None))
    return out


def test_frames_equal_a_plain_reference():
    rng = random.Random(2)
    frame, rows, now = banking._Frame(1000), [], 0
    for _ in range(2000):
        now += rng.choice([0, 0, 1, 7, 300])
        past = [r for r in rows if now - 1000 <= r[0] < now]
        want = math.fsum(r[1] for r in past) / len(past) if past else 0.0
        assert frame.mean_before(now) == want
        amount, value = round(rng.uniform(0, 99), 2), rng.choice("abc")
        rows.append((now, amount, value))
        frame.add(now, amount, value)
        inside = [r for r in rows if r[0] >= now - 1000]
        assert (len(frame.rows), frame.total, set(frame.values)) == (len(inside), math.fsum(r[1] for r in inside), {r[2] for r in inside})


def test_a_dense_card_is_folded_in_linear_time():
    step = banking.card_step()()
    start = time.process_time()
    out = run(step, 16_000, 2 * 86_400_000)
    assert len(out) == 16_000 and time.process_time() - start < 1.5


def test_the_full_decision_reads_and_moves_little(spark):
    """Scans and exchanges of the plan that is left once the attempts are written."""
    from txguard.queries import all_queries

    for name in ("banking_where_needed", "banking_with_commands"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 6 and plan.count("Exchange") <= 8, plan
