"""Views of the star-schema tables that have the shapes of this engine's own tables.

Each text runs in Spark and in DuckDB; ``{name}`` stands for a table or another
view. The few that explode arrays have a text for each engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")

VIEWS: dict[str, str] = {
    "v_matches": """
        SELECT pair_id, match_id, sx AS source_x, sy AS source_y,
            1.01e0 * sx - 0.02e0 * sy + 3e0 + (l_discount - 0.05e0) * 20e0 + off AS target_x,
            0.015e0 * sx + 0.99e0 * sy - 2e0 + (l_tax - 0.04e0) * 20e0 + off AS target_y,
            l_quantity / 50e0 AS confidence, 0.2e0 + 10e0 * l_tax AS sigma_major,
            least(0.2e0 + 10e0 * l_tax, 0.1e0 + 5e0 * l_discount) AS sigma_minor,
            CAST((l_partkey * 37) % 180 AS DOUBLE) AS angle,
            CASE WHEN l_linestatus = 'O' THEN 'same' ELSE 'cross' END AS domain, l_returnflag <> 'R' AS label
        FROM (SELECT l_suppkey AS pair_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber,
                    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS match_id,
                (CAST(round(l_extendedprice * 100) AS BIGINT) % 51200) / 100e0 AS sx,
                ((l_partkey * 7919 + l_orderkey * 104729) % 51200) / 100e0 AS sy,
                CASE WHEN l_returnflag = 'R' THEN l_quantity * 3e0 ELSE 0e0 END AS off,
                l_discount, l_tax, l_quantity, l_partkey, l_linestatus, l_returnflag
            FROM {lineitem}) AS m""",
    "v_transforms": """
        SELECT pair_id, n, a, b, mu - a * mx - b * my AS c, d, e, mv - d * mx - e * my AS f
        FROM (SELECT pair_id, n, mx, my, mu, mv, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b,
                (xv * yy - yv * xy) / (xx * yy - xy * xy) AS d, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS e
            FROM (SELECT pair_id, count(*) AS n, avg(source_x) AS mx, avg(source_y) AS my, avg(target_x) AS mu, avg(target_y) AS mv,
                    var_pop(source_x) AS xx, var_pop(source_y) AS yy, covar_pop(source_x, source_y) AS xy,
                    covar_pop(source_x, target_x) AS xu, covar_pop(source_y, target_x) AS yu,
                    covar_pop(source_x, target_y) AS xv, covar_pop(source_y, target_y) AS yv
                FROM {v_matches} WHERE label GROUP BY pair_id) AS s WHERE n >= 3 AND xx * yy - xy * xy > 1e-12) AS t""",
    "v_residuals": """
        SELECT m.*, t.a, t.b, t.c, t.d, t.e, t.f,
            sqrt((t.a * source_x + t.b * source_y + t.c - target_x) * (t.a * source_x + t.b * source_y + t.c - target_x)
               + (t.d * source_x + t.e * source_y + t.f - target_y) * (t.d * source_x + t.e * source_y + t.f - target_y)) AS error
        FROM {v_matches} AS m JOIN {v_transforms} AS t ON m.pair_id = t.pair_id""",
    "v_products": """
        SELECT c_custkey AS product_id, CASE c_custkey % 3 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC' ELSE 'IIRS' END AS sensor,
            lon - half AS west_lon, lon + half AS east_lon, lat - half AS south_lat, lat + half AS north_lat,
            CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 17 % 3600) / 10e0 END AS sun_azimuth,
            CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey * 29 % 900) / 10e0 END AS sun_elevation,
            CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey * 31 % 900) / 10e0 END AS incidence,
            CASE c_custkey % 3 WHEN 0 THEN 0.25e0 WHEN 1 THEN 5e0 ELSE 70e0 END * (1 + (c_custkey % 4) / 10e0) AS gsd, acquired
        FROM (SELECT c_custkey, (g * 37 % 3600) / 10e0 + (c_custkey % 3) * 0.3e0 AS lon,
                (g * 53 % 1200) / 10e0 - 60e0 + (c_custkey % 11) * 0.13e0 AS lat,
                CASE c_custkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 1.5e0 ELSE 6e0 END AS half
            FROM (SELECT c_custkey, CAST(floor(c_custkey / 3e0) AS BIGINT) AS g FROM {customer}) AS k) AS c
        LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS TIMESTAMP) AS acquired FROM {orders} GROUP BY o_custkey) AS o ON c_custkey = o_custkey""",
    "v_regions": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 13e0 AS west_lon, n_nationkey * 13e0 + 4e0 AS east_lon,
            n_nationkey * 4e0 - 50e0 AS south_lat, n_nationkey * 4e0 - 48e0 AS north_lat FROM {nation}""",
    "v_dem_bounds": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_regionkey * 70e0 AS west_lon, r_regionkey * 70e0 + 60e0 AS east_lon, -60e0 AS south_lat,
            r_regionkey * 20e0 AS north_lat FROM {region}""",
    "v_dem": "SELECT image_id AS dem_id, x, y, v * 1000e0 AS z FROM {v_pixels}",
    "v_pixels_b": """
        SELECT image_id, x + 3 AS x, y - 2 AS y, v * 1.1e0 + 0.05e0 AS v FROM {v_pixels}
        WHERE x + 3 < 64 AND y - 2 >= 0""",
    "v_trials": """
        SELECT pair_id * 1000000 + match_id AS trial_id, pair_id, match_id,
            a * source_x + b * source_y + c - target_x AS error_x, d * source_x + e * source_y + f - target_y AS error_y,
            sigma_major * sigma_major AS cxx, 0.1e0 * sigma_major * sigma_minor AS cxy, sigma_minor * sigma_minor AS cyy,
            CASE match_id % 20 WHEN 0 THEN 'flat_peak' WHEN 1 THEN 'multimodal' WHEN 2 THEN 'failed' ELSE 'valid' END AS status,
            match_id % 20 > 2 AS is_valid, CASE WHEN match_id % 2 = 0 THEN 'forward' ELSE 'backward' END AS direction,
            match_id % 4 AS magnitude
        FROM {v_residuals}""",
    "v_job_events": """
        SELECT user_id AS job_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
            CASE event_type WHEN 'click' THEN 'Stage 2/7 parse' WHEN 'view' THEN 'Stage 4/7 crop' WHEN 'purchase' THEN 'Stage 7/7 summary'
                WHEN 'error' THEN 'failure' ELSE 'success' END AS line,
            event_type = 'error' AS is_failure, event_type = 'signup' AS is_success, value
        FROM {events}""",
    "v_text": """
        SELECT p_partkey AS id, concat(p_name, ' ', CASE p_partkey % 5 WHEN 0 THEN 'iirs cube' WHEN 1 THEN 'OHRC-strip' WHEN 2 THEN 'tmc2' ELSE p_type END) AS text,
            concat('/data/', CASE p_partkey % 7 WHEN 0 THEN 'ch2_iir_' WHEN 1 THEN 'ch2_ohr_' ELSE 'iirsx_' END, p_brand, '.xml') AS path FROM {part}""",
}

_IMAGES = "SELECT CAST(floor(vec_id / 64e0) AS BIGINT) AS i FROM {embeddings} GROUP BY 1 HAVING count(*) = 64"
SPARK_ONLY = {
    "v_pixels": f"""
        SELECT image_id, CAST(x AS BIGINT) AS x, y, CAST(v AS DOUBLE) AS v
        FROM (SELECT CAST(floor(vec_id / 64e0) AS BIGINT) AS image_id, vec_id % 64 AS y, posexplode(embedding) AS (x, v) FROM {{embeddings}}) AS p
        WHERE image_id IN ({_IMAGES})""",
    "v_cube": """
        SELECT CAST(floor(vec_id / 64e0) AS BIGINT) AS image_id, vec_id % 64 AS x, CAST(0 AS BIGINT) AS y,
            transform(embedding, b -> CAST(b AS DOUBLE)) AS bands FROM {embeddings}""",
    "v_desc": """
        SELECT CAST(vec_id % 20 AS BIGINT) AS pair_id, CASE WHEN label < 5 THEN 'source' ELSE 'target' END AS side, vec_id AS kp_id,
            transform(embedding, b -> CAST(b AS DOUBLE)) AS bands FROM {embeddings}""",
}
DUCK_ONLY = {
    "v_pixels": f"""
        SELECT image_id, x, y, CAST(v AS DOUBLE) AS v
        FROM (SELECT CAST(floor(vec_id / 64e0) AS BIGINT) AS image_id, vec_id % 64 AS y, unnest(range(len(embedding))) AS x, unnest(embedding) AS v
            FROM {{embeddings}}) AS p
        WHERE image_id IN ({_IMAGES})""",
    "v_cube": """
        SELECT CAST(floor(vec_id / 64e0) AS BIGINT) AS image_id, vec_id % 64 AS x, CAST(0 AS BIGINT) AS y,
            list_transform(embedding, lambda b: CAST(b AS DOUBLE)) AS bands FROM {embeddings}""",
    "v_desc": """
        SELECT CAST(vec_id % 20 AS BIGINT) AS pair_id, CASE WHEN label < 5 THEN 'source' ELSE 'target' END AS side, vec_id AS kp_id,
            list_transform(embedding, lambda b: CAST(b AS DOUBLE)) AS bands FROM {embeddings}""",
}


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over the tables, of a folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = (VIEWS | SPARK_ONLY)[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs(text)})


def oracle(text: str) -> str:
    """DuckDB SQL with the views it uses put before it; in ``text`` they stand as ``{name}``."""
    texts = VIEWS | DUCK_ONLY
    order: list[str] = []

    def visit(name: str) -> None:
        if name in texts and name not in order:
            for n in needs(texts[name]):
                visit(n)
            order.append(name)

    for n in needs(text):
        visit(n)
    bare = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    parts = [f"{n} AS ({bare(texts[n])})" for n in order]
    body = bare(text).strip()
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        return "WITH " + ", ".join(parts)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
