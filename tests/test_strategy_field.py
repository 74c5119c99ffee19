"""Recommendations: the guard of the field, and decisions that recommend and that do not."""

import pytest

from lapwing.operators import strategy as S

FIELD = "session_id int, cursor_ms long, driver_id int, excluded_reason string, model_supported boolean"
KEYS = ["session_id", "driver_id", "cursor_ms"]


def test_a_field_is_limited_by_any_other_driver(spark):
    rows = [
        (1, 0, 1, None, True), (1, 0, 2, None, True), (1, 0, 3, None, True),
        (2, 0, 1, None, False), (2, 0, 2, None, True),
        (3, 0, 1, None, True), (3, 0, 2, "terminal_retired", False),
        (3, 9, 1, None, True), (4, 0, 1, None, True),
    ]
    got = S.limited_fields(spark.createDataFrame(rows, FIELD)).collect()
    assert {(r["session_id"], r["cursor_ms"], r["driver_id"]): r["limited_field"] for r in got} == {
        (1, 0, 1): False, (1, 0, 2): False, (1, 0, 3): False, (2, 0, 1): False, (2, 0, 2): True, (3, 0, 1): True,
        (3, 9, 1): False, (4, 0, 1): False,
    }


@pytest.fixture
def decide(spark):
    def run(limited=False, wins=9, flip=False, exceeded=0):
        """Ten iterations of two strategies; "early" wins ``wins`` of them, in one pit-loss mode it loses."""
        rows = []
        for i in range(10):
            mode = ("lower-90", "point", "upper-90")[i % 3]
            early = 2 if i < wins else 9
            if flip and mode == "point":
                early = 9
            rows.append((1, 1, 0, "early", i, early, 5000 + i, i < exceeded, mode))
            rows.append((1, 1, 0, "late", i, 5, 5100 + i, False, mode))
            rows.append((2, 1, 0, "alone", i, 1, 1, False, mode))
        paths = spark.createDataFrame(
            rows, "session_id int, driver_id int, cursor_ms long, strategy_id string, iteration int, position int, "
            "final_time_ms long, local_horizon_exceeded boolean, pit_loss_mode string",
        )
        field = spark.createDataFrame([(1, 1, 0, limited), (2, 1, 0, False)], "session_id int, driver_id int, cursor_ms long, limited_field boolean")
        (row,) = S.recommendations(paths, field, KEYS, 100).collect()
        return row["recommended"], list(row["guard_reasons"]), row["superiority"]

    return run


def test_a_clear_decision_recommends(decide):
    assert decide() == ("early", [], 0.9)


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({"limited": True}, "incomplete_or_fallback_background_field"),
        ({"flip": True, "wins": 10}, "pit_loss_sensitivity_winner_flip"),
        ({"exceeded": 6}, "local_tyre_horizon_exceeded"),
    ],
)
def test_each_guard_alone_refuses(decide, changes, reason):
    recommended, reasons, _ = decide(**changes)
    assert recommended is None and reasons == [reason]


def test_a_narrow_lead_is_not_enough(decide):
    recommended, reasons, superiority = decide(wins=6)
    assert superiority == 0.6 and recommended in ("early", None)
    assert "paired_superiority_below_product_threshold" not in reasons
    assert "paired_superiority_below_product_threshold" in decide(wins=5)[1]
