"""What keeps queries from growing faster than their tables, read off their plans over rows of our own."""

import datetime

import pytest

from lapwing.operators import projection as P
from lapwing.plans import learning_queries as LQ
from lapwing.plans import race_analytics as RA
from lapwing.plans import source_queries as SQ
from lapwing.plans import strategy_queries as TQ
from lapwing.sources import feeds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(1997, 5, 1)
    orders = [(k, k % 3 + 1, "FPO"[k % 3], day + datetime.timedelta(days=365 * (k % 5)), "2-HIGH") for k in range(20)]
    items = [
        (k, (k + n) % 7, k % 4, n, 1.0 + n, 100.0 * k + n, 0.01 * n, 0.01 * (n % 3), "RAN"[n % 3], "OF"[n % 2], day)
        for k in range(20) for n in range(1, 5)
    ]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "customer": ([(k, k) for k in range(1, 4)], "c_custkey long, c_nationkey long"),
        "supplier": ([(k, f"S{k}", k) for k in range(4)], "s_suppkey long, s_name string, s_nationkey long"),
        "nation": ([(k, f"N {k}") for k in range(4)], "n_nationkey long, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_draws_are_dealt_to_tasks_of_their_own(spark):
    """What names the draws is few bytes, so tasks dealt by size would be one; and draws are compiled, not interpreted."""
    counts = spark.createDataFrame([("s", 3)], "stratum string, completed_count long")
    samples = spark.createDataFrame([("s", i, i) for i in range(50)], "stratum string, id long, bytes long")
    plan = _plan(P.bootstrap_totals(counts, samples, "id", 20, block=8))
    assert plan.count("REPARTITION_BY_NUM") == 2 and "lambda" not in plan


def test_bundle_is_joined_once(spark, folder):
    """Training and scoring read a stored table; every pass over it joined laps and orders anew."""
    laps = LQ.bundle_laps(spark, folder)
    assert "Join" not in _plan(laps)
    assert laps.count() == 80 and {r["split"] for r in laps.select("split").collect()} >= {"train", "validation", "test"}


def test_examples_are_joined_once(spark, folder):
    rows = LQ.examples(spark, folder)
    assert "Join" not in _plan(rows) and rows.count() == 80


def test_observations_deal_rows_before_they_gather_values(spark, folder):
    """Values of medians and first rows are gathered behind the shuffle: buffers are no smaller than the rows."""
    obs = RA.build_observations(spark, folder)
    plan = _plan(obs)
    assert plan.count("REPARTITION_BY_COL") == 2
    got = obs.where("recorded_lap_count > 0").count()
    assert 0 < got == obs.count()


def test_status_lines_are_parsed_once(spark):
    """Scans read their input three times; what they read is parsed and stored."""
    lines = spark.createDataFrame([(1, 1, '00:00:01.000{"Status": "Started"}')], "session_id int, number long, line string")
    out = feeds.parse_status_lines(lines, 4)
    assert "parse_json" not in _plan(out).lower()
    assert [(r["millis"], r["status"], r["issues"]) for r in out.collect()] == [(1000, "Started", [])]


def test_dump_entries_deal_rows_before_they_sort(spark, folder):
    """The first row of an entry was found by sorting whole files."""
    entries = SQ.dump_tables(spark, folder)["session_entry"]
    assert _plan(entries).count("REPARTITION_BY_COL") == 1
    assert entries.count() == len(set(map(tuple, spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect())))


def test_dump_is_compressed(spark, folder):
    """As plain text the files were larger than the shuffled rows."""
    laps = SQ.csv_dump_laps(spark, folder)
    assert all(f.endswith(".csv.gz") for f in laps.inputFiles())
    assert sorted(map(str, laps.collect())) == sorted(map(str, SQ.dump_laps(spark, folder).collect()))


def test_decisions_are_joined_once(spark, folder):
    """Paths and cars of a decision are read several times; each reading joined orders and line items anew."""
    simulated, limited = TQ.decisions(spark, folder)
    assert "Join" not in _plan(simulated) and _plan(limited).count("Join") == 1
    assert simulated.count() == 60
    assert _plan(TQ.paths(spark, folder)).count("REPARTITION_BY_COL") == 1
