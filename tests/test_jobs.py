import json

from pyspark.sql import functions as F

from fieldtally.plans import etl, kpis, participation
from fieldtally.sources import extraction, proxy, tables

D = "/root/testdata/sf0.001"


def test_refresh_writes_every_table_and_updates_codes(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in (
        "reports", "app_users", "sampling_effort", "reports_response", "areas", "ecoregions", "pixels", "reports_transf",
        "app_users_transf", "sampling_effort_transf", "reports_response_transf", "gadm_legend", "ecoregions_legend",
        "human_presence", "reports_codes")}
    sources = {"records": proxy.map_records, "uploads": proxy.uploads, "annotations": proxy.annotations,
               "users": proxy.raw_users, "fixes": proxy.fixes, "responses": proxy.reports_response}
    extraction.run_extracts(extraction.extracts(proxy.OWN_APP), lambda n: sources[n](spark, D), lambda df, n: tables.write_parquet(df, paths[n]))
    for name, make in (("areas", proxy.areas), ("ecoregions", proxy.eco_layer), ("pixels", proxy.pixels)):
        tables.write_parquet(make(spark, D), paths[name])
    layer = proxy.polygons(spark, D).withColumn("level_name", F.lit("l"))
    layers = dict.fromkeys(("gadm", "climate_regions", "ecoregions"), layer)
    grid = (-1.6, 41.7, 0.05)
    etl.refresh(spark, paths, layers, grid, municipalities=proxy.municipalities(spark, D))
    reports = tables.read_parquet(spark, paths["reports_transf"])
    codes = tables.read_parquet(spark, paths["reports_codes"])
    n = reports.count()
    assert codes.count() == n > 0
    assert reports.columns == etl.REPORT_COLUMNS
    for name in paths:
        assert tables.read_parquet(spark, paths[name]).columns

    # a later run codes new reports only and keeps the codes of the others
    more = tables.read_parquet(spark, paths["reports"]).withColumn("version_uuid", F.col("version_uuid") + 10_000_000)
    tables.write_parquet(more, paths["reports"], mode="append")
    etl.refresh(spark, paths, layers, grid, refresh_codes=False)
    again = tables.read_parquet(spark, paths["reports_codes"])
    assert again.count() == 2 * n == again.select("version_uuid").distinct().count()


def test_files_round_trip(spark, tmp_path):
    r, c = proxy.reports(spark, D, False), proxy.reports_codes(spark, D)
    wide = kpis.inflow(r, c, "name_gadm_level0")
    tables.write_csv(wide, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == wide.columns and back.count() == wide.count()
    tables.write_json_by_day(wide, str(tmp_path / "json"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "json")).collect()]
    merged = {k: v for line in lines for k, v in line.items()}
    row = wide.orderBy("period").first()
    assert merged[row["period"].strftime("%Y-%m-%d")] == {t: row[t] for t in ("adult", "bite", "site")}
    assert len(merged) == wide.count()


def test_exports_are_partitioned(spark, tmp_path):
    out = participation.retention_exports(proxy.reports(spark, D, False), proxy.reports_codes(spark, D), "name_gadm_level0",
                                          ["Total", "ASIA"], ["", "adult"])
    tables.write_by_parameters(out, str(tmp_path / "x"), "entity", "report_type")
    assert (tmp_path / "x" / "entity=ASIA" / "report_type=adult").is_dir()
    assert tables.read_parquet(spark, str(tmp_path / "x")).count() == out.count()


def test_climate_legend(spark, tmp_path):
    (tmp_path / "legend.csv").write_text("code;name\n1;Tropical\n2;Arid\n")
    got = [tuple(r) for r in tables.climate_legend(spark, str(tmp_path / "legend.csv")).collect()]
    assert got == [(1, "Tropical"), (2, "Arid")]


def test_checkpoint_folder_of_the_session_is_used(spark):
    from fieldtally.session import cut_lineage
    assert cut_lineage(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir() is not None


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    tables.write_bucketed(proxy.reports(spark, D, False), "b_reports", "version_uuid", 4, str(tmp_path / "r"))
    tables.write_bucketed(proxy.reports_codes(spark, D), "b_codes", "version_uuid", 4, str(tmp_path / "c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from fieldtally.operators.tables import with_scale
        joined = with_scale(spark.table("b_reports"), spark.table("b_codes"), "name_gadm_level0")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == proxy.reports(spark, D, False).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_reports")
        spark.sql("DROP TABLE b_codes")


def test_frequent_keys_join_like_a_plain_join(spark):
    from fieldtally.operators.tables import join_hot
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_anti"):
        if how == "left_anti":
            assert join_hot(many, one, ["k"], how).count() == many.join(one, "k", how).count()
            continue
        a = sorted(map(str, join_hot(many, one, ["k"], how).select("k", "v", "w").collect()))
        b = sorted(map(str, many.join(one, "k", how).select("k", "v", "w").collect()))
        assert a == b


def test_equal_rows_of_a_frequent_key_are_dealt_out(spark):
    """100,000 equal rows and keys of another integer type; cold keys are not repeated."""
    from fieldtally.operators.tables import join_hot
    many = spark.range(120_000).select(F.when(F.col("id") < 100_000, 7).otherwise(F.col("id")).cast("int").alias("k"), F.lit("same").alias("v"))
    one = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_hot(many, one, ["k"])
        assert out.count() == 120_000 and out.filter("k = 7 and w = 14").count() == 100_000
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("sequence(0, (_parts") == 1 and "approx_top_k" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nulls = spark.createDataFrame([(None, i) for i in range(500)] + [(1, 1)], "k long, v long")
    assert join_hot(nulls, one, ["k"], "left").count() == 501 and join_hot(nulls, one, ["k"]).count() == 1


def test_entity_options_settle_null_names(spark):
    codes = spark.createDataFrame([("a", "Spain"), ("b", None), ("c", "Italy"), ("d", "Spain")], "version_uuid string, name string")
    assert [r.entity for r in kpis.entity_options(codes, "name").collect()] == ["Total", "Italy", "Spain"]


def test_province_gaps_and_options_read_whole_tables(spark, monkeypatch):
    from fieldtally import registry
    read = {}
    monkeypatch.setattr(etl, "province_gaps", lambda areas, known: read.update(gaps=known.count()))
    monkeypatch.setattr(kpis, "entity_options", lambda codes, scale: read.update(options=codes.count()))
    for name in ("etl_province_gaps", "kpi_entity_options"):
        registry.queries()[name](spark, D)
    assert read == {"gaps": proxy.municipalities(spark, D).count(), "options": proxy.reports_codes(spark, D).count()}
