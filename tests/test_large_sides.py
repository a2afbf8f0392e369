"""Sides of joins that grow as they are dealt into cells are never broadcast, however small the planner takes them to be."""

import pytest

from pixelframe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def broadcast_and_dealt(df):
    """Lines of the plan that explode rows below a broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for j in range(k + 1, len(lines)):
                if depth[j] <= depth[k]:
                    break
                if "Generate explode(" in lines[j]:
                    found.append(lines[j])
    return found


RENDERED = (
    "mog_cutoff mcmc_flux multi_image_fit render_composite gauss_newton_fit render_dev all_derivs column_scaling chi_image catalog_export fitstats_source damped_step fitstats_image flux_derivs flux_ivar "
    "forced_phot_pairs forced_phot_isolated forced_phot_priors lbfgs_fit shape_derivs source_param_derivs image_param_derivs loglike mog_grid"
).split()


@pytest.mark.parametrize("name", RENDERED)
def test_sources_in_blocks_are_not_broadcast(spark, name):
    assert broadcast_and_dealt(QUERIES[name](spark, SF)) == [], name


@pytest.mark.parametrize("name", ["galaxy_fft", "pixel_psf_phot"])
def test_blocks_of_images_are_not_broadcast(spark, name):
    assert broadcast_and_dealt(QUERIES[name](spark, SF)) == [], name


@pytest.mark.parametrize("name", ["smooth", "lanczos_shift", "detection_map"])
def test_convolution_shuffles_pixels_once(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(") == 3, name  # the fixture's sum, the blocks, the sums of blocks


def test_candidates_spread_bright_pixels_only(spark):
    text = QUERIES["candidate_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "> 100.0)" in text[text.rindex("Generate explode(") :]


@pytest.mark.parametrize("name", "nearest_scaled pixel_match xmatch_self xmatch_all greedy_merge footprint box_overlap".split())
def test_cells_are_not_broadcast(spark, name):
    assert broadcast_and_dealt(QUERIES[name](spark, SF)) == [], name


def test_footprint_meets_positions_once(spark, tmp_path):
    """Rows at one position are one candidate, however many there are."""
    import pyspark.sql.functions as F

    rows = spark.range(3000)
    rows.select((F.col("id") * 3600).alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit("A").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    rows.select((F.col("id") * 3600).alias("p_partkey"), F.lit(1.0).alias("p_retailprice"), F.lit(1).alias("p_size"), F.lit("B").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["footprint"](spark, str(tmp_path))
    assert got.count() == 3000
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[ra" in text[text.rindex("Generate explode(") :]  # the fields are distinct before they are dealt
