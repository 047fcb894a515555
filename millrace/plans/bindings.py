"""The library's input frames, bound to the driver's tables.

Every view is one SELECT that Spark and DuckDB both run: Spark gets the
relations it names as DataFrames, DuckDB as common table expressions. For some
of them Spark has a text of its own, which gives the same rows in one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # a product catalogue; prices in cents are whole, costs are cut to cents
    "catalog": """SELECT p_partkey AS catalog_idx, CAST(p_partkey AS STRING) AS code, p_name AS name, p_brand AS brand, p_type AS category,
        'M' || CAST(p_size AS STRING) AS model, 'u' || CAST(p_partkey % 3 AS STRING) AS unit, 'S' || CAST(p_partkey % 10 AS STRING) AS supplier,
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'on' END AS status, p_retailprice AS market_price,
        CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 0.0 ELSE floor(p_retailprice * 70) / 100 END AS cost_price,
        CASE WHEN p_partkey % 3 = 0 THEN 'img/' || CAST(p_partkey AS STRING) || '.png' END AS image_url,
        '<p>' || p_name || ' &amp;  <b>' || p_type || '</b></p>' AS intro FROM {part}""",
    "offers": """SELECT l_partkey AS catalog_idx, s_name AS supplier, l_suppkey AS suppkey, floor(p_retailprice * (100 + l_suppkey % 10)) / 100 AS price
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) AS d JOIN {supplier} ON s_suppkey = l_suppkey JOIN {part} ON p_partkey = l_partkey""",
    "quotes": """SELECT o_orderkey AS quote_id, c_name AS customer_name, o_orderdate AS created_at, o_totalprice AS stated_total FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "lines": """SELECT l_orderkey AS quote_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_index,
        l_partkey AS catalog_idx, p_name AS name, 'M' || CAST(p_size AS STRING) AS spec, 'u' || CAST(p_partkey % 3 AS STRING) AS unit, p_brand AS brand,
        l_quantity AS quantity, floor(l_extendedprice / l_quantity * 100) / 100 AS budget_price,
        CASE WHEN l_linenumber % 2 = 0 THEN 'r' || CAST(l_linenumber AS STRING) ELSE '' END AS remark, 'c' || CAST(l_linenumber % 4 AS STRING) AS color,
        CASE l_returnflag WHEN 'A' THEN 'select' WHEN 'R' THEN 'no_match' ELSE 'ask_boss' END AS action, l_linestatus = 'F' AS confirmed, l_shipdate AS decided_at
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "results": """SELECT l.*, c.code, c.category, c.model, c.supplier, c.market_price, c.cost_price, c.image_url, c.unit AS product_unit, c.name AS product_name, c.brand AS product_brand
        FROM {lines} AS l JOIN {catalog} AS c ON c.catalog_idx = l.catalog_idx""",
    # lines with candidates: n_matches of them, the first with best_score; some have a selected product, some an alternative
    "work": """SELECT *, catalog_idx % 4 AS n_matches, CAST(catalog_idx * 37 % 100 AS DOUBLE) / 100 AS best_score, action = 'select' AND catalog_idx % 5 <> 0 AS has_selected,
        catalog_idx % 8 = 0 AS has_alternative, image_url IS NOT NULL AS has_image FROM {results}""",
    "sheet_files": """SELECT c_custkey AS file_id, c_custkey % 6 + 3 AS n_headers, c_mktsegment AS header_signature, 'i' || CAST(c_nationkey AS STRING) AS identifier_signature, CASE WHEN c_custkey % 3 = 0 THEN 'ocr' ELSE 'excel' END AS source_type FROM {customer}""",
    "sheet_identifiers": """SELECT o_custkey AS file_id, o_orderpriority AS identifier FROM {orders} UNION SELECT o_custkey, 's' || o_orderstatus FROM {orders}""",
    "templates": """SELECT s_suppkey AS ordinal, s_name AS name, s_suppkey % 6 + 3 AS n_mapping, CASE s_suppkey % 4 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN '' ELSE 'MACHINERY' END AS header_signature, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'i' || CAST(s_nationkey AS STRING) END AS identifier_signature,
        s_suppkey % 14 AS usage_count, s_suppkey % 13 AS confirm_count, s_suppkey % 7 AS manual_save_count, s_suppkey % 9 AS mapping_change_count, CASE WHEN s_suppkey % 2 = 0 THEN 'ocr' ELSE 'excel' END AS source_type, CAST('2024-03-01 12:00:00' AS TIMESTAMP) - INTERVAL 5 DAY AS last_used_at FROM {supplier}""",
    "template_identifiers": """SELECT name, identifier FROM {templates} JOIN (SELECT DISTINCT o_orderpriority AS identifier FROM {orders}) AS p ON ordinal % 5 < length(identifier) % 7 UNION SELECT name, 'sF' FROM {templates} WHERE ordinal % 3 <> 1""",
    # quote sheets cell by cell: a title, a header, one row per line; some without a title, some with a header of two rows, some lying on their side
    "sheet_cells": """SELECT quote_id AS file_id, CASE WHEN quote_id % 5 = 0 THEN col_idx ELSE row_idx END AS row_idx, CASE WHEN quote_id % 5 = 0 THEN row_idx ELSE col_idx END AS col_idx, value FROM (
        SELECT quote_id, CAST(item_index + CASE WHEN quote_id % 5 = 2 THEN 2 WHEN quote_id % 5 IN (0, 1) THEN 0 ELSE 1 END AS BIGINT) AS row_idx, c AS col_idx, CASE c WHEN 0 THEN CAST(item_index AS STRING) WHEN 1 THEN '手套 ' || name WHEN 2 THEN unit WHEN 3 THEN CAST(CAST(quantity AS INT) AS STRING)
            WHEN 4 THEN CASE WHEN item_index % 4 = 3 THEN '面议' ELSE CAST(budget_price AS STRING) END WHEN 5 THEN CASE WHEN item_index % 3 = 0 THEN NULL ELSE spec END ELSE CASE WHEN item_index % 2 = 0 THEN '符合GB 2626' ELSE remark END END AS value FROM {lines} CROSS JOIN {columns7}
        UNION ALL SELECT quote_id, CAST(CASE WHEN quote_id % 5 IN (0, 1) THEN 0 ELSE 1 END AS BIGINT), c, CASE c WHEN 0 THEN '序号' WHEN 1 THEN '物资名称' WHEN 2 THEN '计量单位' WHEN 3 THEN '数量' WHEN 4 THEN '预算单价（元）' WHEN 5 THEN '规格型号' ELSE '备注' END FROM (SELECT DISTINCT quote_id FROM {lines}) AS q CROSS JOIN {columns7}
        UNION ALL SELECT quote_id, CAST(2 AS BIGINT), c, CASE c WHEN 1 THEN '品名' WHEN 3 THEN '采购数量' WHEN 4 THEN '含税单价' WHEN 6 THEN '技术要求' END FROM (SELECT DISTINCT quote_id FROM {lines} WHERE quote_id % 5 = 2) AS q CROSS JOIN {columns7}
        UNION ALL SELECT quote_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '报价单 ' || CAST(quote_id AS STRING) FROM (SELECT DISTINCT quote_id FROM {lines} WHERE quote_id % 5 IN (2, 3, 4)) AS q) AS s""",
    "columns7": """SELECT CAST(c AS BIGINT) AS c FROM (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS k""",
    # scanned quote lines as boxes: seven fields of every line at their places, some lines going on below, a note at the right
    "boxes": """SELECT quote_id AS image_id, item_index * 10 + c AS box_no, CASE c WHEN 0 THEN CASE WHEN item_index % 3 = 0 THEN 'l' || CAST(item_index AS STRING) ELSE CAST(item_index AS STRING) END WHEN 1 THEN name WHEN 2 THEN spec WHEN 3 THEN color WHEN 4 THEN unit WHEN 5 THEN CAST(CAST(quantity AS INT) AS STRING) || CASE WHEN item_index % 5 = 0 THEN 'O' ELSE '' END
            ELSE CASE WHEN item_index % 4 = 0 THEN 'x' || name ELSE '' END END AS text,
        CAST((item_index * 7 + c * 13) % 60 + 40 AS DOUBLE) / 100 AS confidence,
        CAST(CASE c WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 300 WHEN 3 THEN 520 WHEN 4 THEN 590 WHEN 5 THEN 660 ELSE 110 END AS INT) AS x1, CAST(CASE c WHEN 0 THEN 50 WHEN 1 THEN 180 WHEN 2 THEN 400 WHEN 3 THEN 560 WHEN 4 THEN 620 WHEN 5 THEN 700 ELSE 190 END AS INT) AS x2,
        CAST(item_index * 100 + CASE WHEN c = 6 THEN 45 ELSE c % 3 * 2 END AS INT) AS y1, CAST(item_index * 100 + CASE WHEN c = 6 THEN 65 ELSE 20 + c % 3 * 2 END AS INT) AS y2 FROM {lines} CROSS JOIN {columns7}
        UNION ALL SELECT quote_id, item_index * 10 + 7, '备注说明', CAST(0.9 AS DOUBLE), 900, 1000, CAST(item_index * 100 AS INT), CAST(item_index * 100 + 20 AS INT) FROM {lines}""",
    # raw request texts as customers write them
    "requests": """SELECT quote_id, item_index,
        CASE item_index % 8 WHEN 0 THEN '加厚布手套' WHEN 1 THEN ' 棉手套 ' WHEN 2 THEN '（防护）头盔/' WHEN 3 THEN '' WHEN 4 THEN upper(name) WHEN 5 THEN '雨 靴' ELSE name || ' ' || spec END AS raw_name,
        CASE item_index % 6 WHEN 0 THEN 'GB 2626/2019' WHEN 1 THEN '10 × 20' WHEN 2 THEN '（L）－X' WHEN 3 THEN '' ELSE spec END AS raw_spec,
        CASE item_index % 5 WHEN 0 THEN 'KG' WHEN 1 THEN ' 付 ' WHEN 2 THEN 'pcs' WHEN 3 THEN '' ELSE unit END AS raw_unit,
        CASE item_index % 6 WHEN 0 THEN '1,234.5' WHEN 1 THEN '12.0' WHEN 2 THEN '若干' WHEN 3 THEN '--' WHEN 4 THEN '' ELSE CAST(CAST(quantity AS INT) AS STRING) END AS raw_quantity,
        remark, brand FROM {lines}""",
    "feedback": """SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'select' WHEN 'error' THEN 'no_match' WHEN 'signup' THEN 'ask_boss' END AS action,
        'q' || CAST(user_id % 40 AS STRING) AS query_signature, 'n' || CAST(user_id % 25 AS STRING) AS normalized_name, 's' || CAST(user_id % 3 AS STRING) AS normalized_spec, 'u' || CAST(user_id % 2 AS STRING) AS normalized_unit,
        'm' || CAST(user_id % 15 AS STRING) AS mapping_signature, CASE WHEN event_type = 'purchase' THEN CAST(user_id AS STRING) ELSE '' END AS selected_product_code,
        CAST(event_id % 50 AS STRING) AS top_candidate_code, (event_id % 100) / 100.0 AS top_candidate_score, event_id % 6 AS selected_rank,
        event_id % 3 = 0 AS template_hit, event_id % 5 = 0 AS mapping_changed, event_id % 2 = 0 AS with_product_image, (100 + event_id % 4 * 12) / 100.0 AS feedback_weight
        FROM {events} WHERE event_type IN ('purchase', 'error', 'signup')""",
    "asked": """SELECT DISTINCT query_signature, normalized_name, normalized_spec, normalized_unit, mapping_signature FROM {feedback}""",
    "confirms": """SELECT event_id AS id, ts AS confirmed_at, 'T' || CAST(user_id % 20 AS STRING) AS template_name, 'S' || CAST(event_id % 3 AS STRING) AS signature, event_type = 'click' AS manual_save, event_type <> 'view' AS template_hit FROM {events}""",
    "shares": """SELECT event_id AS id, ts AS viewed_at, 'h' || CAST(user_id AS STRING) AS share_id FROM {events} WHERE event_type = 'view'""",
    "cells": """SELECT conv_id AS file_id, turn AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, CASE col_idx WHEN 0 THEN role WHEN 1 THEN text WHEN 2 THEN CASE WHEN turn % 3 = 0 THEN '' ELSE CAST(turn AS STRING) END ELSE CASE WHEN turn = 0 THEN '数量' ELSE CAST(turn * 7 AS STRING) END END AS value
        FROM {conversations} CROSS JOIN (SELECT 0 AS col_idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS k""",
}

#: Views as Spark reads them, where that differs: the same rows in one pass over the lines, which stay where the window
#: that numbers them left them (by quote), so that steps by quote, sheet or page shuffle nothing again.
IN_ONE_PASS = {
    # what is told of a line is told after the window, which moves each of its columns once and is known to lie by quote
    "lines": """SELECT l_orderkey AS quote_id, item_index, l_partkey AS catalog_idx, p_name AS name, 'M' || CAST(p_size AS STRING) AS spec, 'u' || CAST(l_partkey % 3 AS STRING) AS unit, p_brand AS brand,
        l_quantity AS quantity, floor(l_extendedprice / l_quantity * 100) / 100 AS budget_price,
        CASE WHEN l_linenumber % 2 = 0 THEN 'r' || CAST(l_linenumber AS STRING) ELSE '' END AS remark, 'c' || CAST(l_linenumber % 4 AS STRING) AS color,
        CASE l_returnflag WHEN 'A' THEN 'select' WHEN 'R' THEN 'no_match' ELSE 'ask_boss' END AS action, l_linestatus = 'F' AS confirmed, l_shipdate AS decided_at
        FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate, p_name, p_size, p_brand,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_index
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) AS n""",
    # 0 to 6: a line's cells; beside each quote's first line 7 to 13: the header, 14 to 20: its second row, the last: a title
    "sheet_cells": """SELECT file_id, CASE WHEN file_id % 5 = 0 THEN col_idx ELSE row_idx END AS row_idx, CASE WHEN file_id % 5 = 0 THEN row_idx ELSE col_idx END AS col_idx, value FROM (
        SELECT quote_id AS file_id, k % 7 AS col_idx, CAST(CASE k DIV 7 WHEN 0 THEN item_index + CASE WHEN quote_id % 5 = 2 THEN 2 WHEN quote_id % 5 IN (0, 1) THEN 0 ELSE 1 END WHEN 1 THEN CASE WHEN quote_id % 5 IN (0, 1) THEN 0 ELSE 1 END WHEN 2 THEN CASE WHEN quote_id % 5 = 2 THEN 2 ELSE 0 END ELSE 0 END AS BIGINT) AS row_idx,
            CASE k WHEN 0 THEN CAST(item_index AS STRING) WHEN 1 THEN '手套 ' || name WHEN 2 THEN unit WHEN 3 THEN CAST(CAST(quantity AS INT) AS STRING)
            WHEN 4 THEN CASE WHEN item_index % 4 = 3 THEN '面议' ELSE CAST(budget_price AS STRING) END WHEN 5 THEN CASE WHEN item_index % 3 = 0 THEN NULL ELSE spec END WHEN 6 THEN CASE WHEN item_index % 2 = 0 THEN '符合GB 2626' ELSE remark END
            WHEN 7 THEN '序号' WHEN 8 THEN '物资名称' WHEN 9 THEN '计量单位' WHEN 10 THEN '数量' WHEN 11 THEN '预算单价（元）' WHEN 12 THEN '规格型号' WHEN 13 THEN '备注'
            WHEN 14 THEN CASE WHEN quote_id % 5 <> 2 THEN '报价单 ' || CAST(quote_id AS STRING) END WHEN 15 THEN '品名' WHEN 17 THEN '采购数量' WHEN 18 THEN '含税单价' WHEN 20 THEN '技术要求' WHEN 21 THEN '报价单 ' || CAST(quote_id AS STRING) END AS value
        FROM {lines} LATERAL VIEW explode(sequence(0L, CASE WHEN item_index > 1 THEN 6L WHEN quote_id % 5 = 2 THEN 21L WHEN quote_id % 5 IN (3, 4) THEN 14L ELSE 13L END)) AS k) AS s""",
    # 0 to 6: the boxes of a line, 7: the note at its right
    "boxes": """SELECT quote_id AS image_id, item_index * 10 + c AS box_no, CASE c WHEN 0 THEN CASE WHEN item_index % 3 = 0 THEN 'l' || CAST(item_index AS STRING) ELSE CAST(item_index AS STRING) END WHEN 1 THEN name WHEN 2 THEN spec WHEN 3 THEN color WHEN 4 THEN unit WHEN 5 THEN CAST(CAST(quantity AS INT) AS STRING) || CASE WHEN item_index % 5 = 0 THEN 'O' ELSE '' END
            WHEN 6 THEN CASE WHEN item_index % 4 = 0 THEN 'x' || name ELSE '' END ELSE '备注说明' END AS text,
        CASE c WHEN 7 THEN CAST(0.9 AS DOUBLE) ELSE CAST((item_index * 7 + c * 13) % 60 + 40 AS DOUBLE) / 100 END AS confidence,
        CAST(CASE c WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 300 WHEN 3 THEN 520 WHEN 4 THEN 590 WHEN 5 THEN 660 WHEN 6 THEN 110 ELSE 900 END AS INT) AS x1, CAST(CASE c WHEN 0 THEN 50 WHEN 1 THEN 180 WHEN 2 THEN 400 WHEN 3 THEN 560 WHEN 4 THEN 620 WHEN 5 THEN 700 WHEN 6 THEN 190 ELSE 1000 END AS INT) AS x2,
        CAST(item_index * 100 + CASE c WHEN 6 THEN 45 WHEN 7 THEN 0 ELSE c % 3 * 2 END AS INT) AS y1, CAST(item_index * 100 + CASE c WHEN 6 THEN 65 WHEN 7 THEN 20 ELSE 20 + c % 3 * 2 END AS INT) AS y2 FROM {lines} LATERAL VIEW explode(sequence(0L, 7L)) AS c""",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound view, or a table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = IN_ONE_PASS.get(name, VIEWS[name])
    return spark.sql(text, **{n: bind(spark, sf_dir, n) for n in _needs(text)})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as {view} put before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            if n not in BASE and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
