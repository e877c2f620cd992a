"""The run-time report: counts observed in the pass that is timed, and kernels that agree with the plans."""

import numpy as np
import pytest

from framewright.functions import vec
from framewright.operators import score, templates
from framewright.plans import evaluate


def frames(spark, n=120, dim=8):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(i, i % 3, (v * (1 + i % 5)).tolist()) for i, v in enumerate(rng.standard_normal((n, dim)))], "row_id long, label int, x array<double>").repartition(3)


@pytest.mark.parametrize("mode", ["time", "fft", "cosine"])
def test_one_pass_counts_what_the_plans_count(spark, mode):
    f = frames(spark)
    mu = templates.templates(f, 3, 8, vec.LENGTH_FLOOR if mode == "cosine" else vec.ENERGY_FLOOR)
    want = score.accuracy(score.predict(f, mu, mode)).first()
    got = evaluate.one_pass(f, mu, mode)
    assert (got["total"], got["correct"]) == (want["total"], want["correct"]) == (120, want["correct"])
    assert got["load_s"] > 0 and got["score_s"] > 0 and got["wall_s"] > 0
    timed = score.predict_timed(f, mu, mode)
    plan = {(r["row_id"], r["pred"]) for r in score.predict(f, mu, mode).collect()}
    assert {(r["row_id"], r["pred"]) for r in timed.collect()} == plan


def test_no_frames_and_unknown_modes(spark):
    f = frames(spark, 10)
    mu = templates.templates(f, 3, 8)
    got = evaluate.one_pass(f.where("row_id < 0"), mu, "time")
    assert (got["total"], got["correct"]) == (0, 0)
    with pytest.raises(ValueError, match="mode"):
        score.kernel(np.ones((1, 2)), np.ones((1, 2)), "shifts")


def test_equal_scores_go_to_the_smallest_label(spark):
    mu = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (4, [0.0, 1.0])], "label int, mu array<double>")
    f = spark.createDataFrame([(0, 1, [3.0, 0.0])], "row_id long, label int, x array<double>")
    assert [score.predict_timed(f, mu, m).first()["pred"] for m in ("time", "cosine", "fft")] == [1, 1, 1]
