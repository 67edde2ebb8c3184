"""Daily partials add up to the baselines over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txguard.plans import baselines, daily

AS_OF = "2024-03-05"
SCHEMA = "card_id string, merchant_id string, amount double, ts timestamp, fraud_label string, n_days string"


@pytest.fixture(scope="module")
def tx(spark):
    """45 days around a month's end; card 'hot' has a third of all rows, some rows lack a value."""
    pick = random.Random(5)
    rows = []
    for i in range(6000):
        card = "hot" if i % 3 == 0 else None if i % 97 == 0 else f"c{pick.randrange(40)}"
        at = datetime(2024, 1, 22) + timedelta(seconds=pick.randrange(45 * 86400))
        rows.append((card, None if i % 31 == 0 else f"m{pick.randrange(900)}", None if i % 53 == 0 else pick.randrange(1, 900) / 4, None if i % 211 == 0 else at,
                     "confirmed" if i % 7 == 0 else None, "clashing"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


@pytest.fixture(scope="module")
def path(spark, tx, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("daily"))
    part = F.pmod(F.xxhash64("merchant_id", "amount"), F.lit(3))
    for batch in (0, 1, 1, 2, 0):
        daily.add_batch(tx.where(part == batch), root, batch)
    return root


@pytest.mark.parametrize("strict", [False, True])
def test_cards(spark, tx, path, strict):
    names = ["card__tx_count_30d", "card__amount_sum_30d", "card__amount_avg_30d", "card__tx_count_7d"]
    want = {r["card_id"]: r for r in baselines.card_baselines(tx, AS_OF, strict).collect()}
    got = {r["card_id"]: r for r in daily.card_baselines(spark, path, AS_OF, strict).collect()}
    assert got.keys() == want.keys() and None in got
    # Amounts are quarters, so sums are exact in any order.
    assert all(tuple(got[k][n] for n in names) == tuple(want[k][n] for n in names) for k in want)
    assert all(abs(got[k]["card__unique_merchants_30d"] - want[k]["card__unique_merchants_30d"]) <= 0.05 * want[k]["card__unique_merchants_30d"] + 1 for k in want)
    assert want["hot"]["card__unique_merchants_30d"] > 600


def test_merchants(spark, tx, path):
    want = sorted(tuple(r) for r in baselines.merchant_risk(tx, AS_OF).collect())
    got = sorted(tuple(r) for r in daily.merchant_risk(spark, path, AS_OF).select(*baselines.merchant_risk(tx, AS_OF).columns).collect())
    assert got == want


def test_nothing_stored_and_late_rows(spark, tx, tmp_path):
    root = str(tmp_path / "d")
    daily.add_batch(tx.limit(0), root, 0)
    assert daily.card_baselines(spark, root, AS_OF).count() == daily.merchant_risk(spark, root, AS_OF).count() == 0
    rows = spark.createDataFrame([("a", "m", 1.0, datetime(2024, 3, 1), None, ""), ("a", "m", 2.0, datetime(2024, 2, 10), None, "")], SCHEMA)
    daily.add_batch(rows.limit(1), root, 1)
    daily.add_batch(rows, root, 2)
    row = daily.card_baselines(spark, root, AS_OF).first()
    assert (row["card__tx_count_30d"], row["card__tx_count_7d"], row["card__amount_sum_30d"], row["card__unique_merchants_30d"]) == (3, 2, 4.0, 1)
