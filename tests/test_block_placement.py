from accesslens import schemas
from accesslens.operators import features as fe
from accesslens.operators.scan import SkewConfig, running_totals, with_context
from accesslens.session import written
from test_features import event


def moves(node, column):
    """Shuffles below a node of a physical plan that carry a column."""
    children = node.children()
    own = node.getClass().getSimpleName() == "ShuffleExchangeExec" and column in node.output().toString()
    return own + sum(moves(children.apply(i), column) for i in range(children.size()))


def test_rows_of_blocks_move_once(spark):
    # Each window over a value and each join with earlier blocks moved the rows: ten times and more.
    skew = SkewConfig(hot_rows=60, block_rows=16, salts=4)
    events = spark.createDataFrame([event(i, minutes=7 * i, seconds=i % 9) for i in range(80)], schemas.event_schema())
    rows = running_totals(fe.prepared(events), [fe.F.col(c) for c in fe.ORDER], {"_rn": fe.F.lit(1)}, (fe.KEY,))
    rows = written(with_context(rows, "_rn", skew).drop("_copy"), "blocks")
    counted = fe._blocked_not_above(fe._blocked_value_counts(rows), rows, 80, skew)
    assert moves(counted._jdf.queryExecution().executedPlan().inputPlan(), "command_sequence") == 1
    # The block's own earlier rows and those of earlier blocks.
    got = {r.event_id: (r["_le"], r["_n_resource"]) for r in counted.collect()}
    data = [event(i, minutes=7 * i, seconds=i % 9) for i in range(80)]
    resource = lambda e: e["resource_accessed"] if isinstance(e, dict) else e[schemas.event_schema().names.index("resource_accessed")]
    assert list(got[f"e{i:03d}"] for i in range(80)) == [
        (sum(k % 9 <= i % 9 for k in range(i)), sum(resource(data[k]) == resource(data[i]) for k in range(i))) for i in range(80)
    ]
