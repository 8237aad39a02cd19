"""What is shuffled where each lot's print meets that of its coin."""

from tessera.plans import queries


def test_lots_are_joined_before_their_prints_are_made(spark):
    plan = queries.QUERIES["print_compare"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join Inner, (item_id" in line)
    lots = plan[join + 1]  # the join's left side
    assert "map(dateSpacing" not in lots and any("map(dateSpacing" in line for line in plan[:join])
