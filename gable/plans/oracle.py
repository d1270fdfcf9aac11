"""The registered queries as plain SQL over the test tables, written row by row
from the definition of each result rather than from the DataFrame plans."""

from gable import schemas
from gable.bindings import RAW_TEXTS
from gable.fixed import AREA_TYPES

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "postcodes": ((), """
        SELECT n_name AS postcode, concat('Street ', n_nationkey % 7) AS street,
               concat('Town ', n_nationkey) AS town, concat('District ', n_nationkey % 10) AS district,
               concat('County ', n_nationkey % 4) AS county, concat('N', n_nationkey) AS outcode,
               substr(r_name, 1, 2) AS area, concat('N', n_nationkey, ' ', n_nationkey % 10) AS sector
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "houses": ((), """
        SELECT CAST(c_custkey AS VARCHAR) AS houseid, CAST(c_custkey % 50 AS VARCHAR) AS paon,
               CASE WHEN c_custkey % 4 = 0 THEN concat('Flat ', c_custkey % 7) END AS saon,
               concat('NATION_', c_nationkey) AS postcode,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'D' WHEN 'AUTOMOBILE' THEN 'S'
                    WHEN 'FURNITURE' THEN 'T' WHEN 'HOUSEHOLD' THEN 'F' WHEN 'MACHINERY' THEN 'O' END AS type
        FROM customer"""),
    "sales": ((), """
        SELECT CAST(o_orderkey AS VARCHAR) AS tui, CAST(round(o_totalprice) AS BIGINT) AS price,
               o_orderdate AS date, o_orderpriority = '1-URGENT' AS new, o_orderstatus <> 'O' AS freehold,
               CASE WHEN o_orderstatus = 'P' THEN 'B' ELSE 'A' END AS ppd_cat,
               CAST(o_custkey AS VARCHAR) AS houseid
        FROM orders"""),
    "lookup": ((), """
        SELECT CAST(c_custkey AS VARCHAR) AS houseid, c_custkey + 100000000 AS uprn
        FROM customer WHERE c_acctbal > 0"""),
    "certificates": ((), """
        SELECT concat('epc-', o_orderkey) AS lmk_key, concat(o_orderkey % 50, ' High Street') AS address1,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('Block ', o_orderkey % 9) END AS address2,
               CAST(NULL AS VARCHAR) AS address3, concat('NATION_', o_orderkey % 25) AS postcode,
               substr('ABCDEFG', CAST(1 + o_orderkey % 7 AS INT), 1) AS current_energy_rating,
               substr('ABCDEFG', CAST(1 + (o_orderkey + 1) % 7 AS INT), 1) AS potential_energy_rating,
               CASE WHEN o_orderkey % 2 = 0 THEN 'House' ELSE 'Flat' END AS property_type,
               CAST(o_orderdate AS DATE) AS lodgement_date,
               CAST((o_orderkey % 400) * 0.25 AS DECIMAL(10, 2)) AS total_floor_area,
               CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey + 100000000 END AS uprn
        FROM orders"""),
    "raw": ((), """
        SELECT concat('{', o_orderkey, '}') AS tui, CAST(round(o_totalprice) AS BIGINT) AS price,
               o_orderdate AS date,
               CASE WHEN c_custkey % 10 = 9 THEN 'BAD CODE' WHEN c_custkey % 10 = 8 THEN 'SW1A 1AA'
                    ELSE concat('LS', c_nationkey + 1, ' ', c_custkey % 10, 'AD') END AS postcode,
               substr(c_mktsegment, 1, 1) AS property_type,
               CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'Y' END AS new_build,
               CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE 'L' END AS duration,
               CAST(c_custkey % 50 AS VARCHAR) AS paon,
               CASE WHEN c_custkey % 4 = 0 THEN concat('Flat ', c_custkey % 7) ELSE '' END AS saon,
               concat('Street ', o_orderkey % 5) AS street, concat('Town ', c_nationkey) AS town,
               concat('District ', c_nationkey % 10) AS district, concat('County ', c_nationkey % 4) AS county,
               CASE WHEN o_orderstatus = 'P' THEN 'B' ELSE 'A' END AS ppd_cat,
               CASE o_orderkey % 10 WHEN 0 THEN 'C' WHEN 1 THEN 'D' ELSE 'A' END AS record_status
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    # Valid test postcodes: letters, then district up to the space, then digit.
    "good": (("raw",), """
        SELECT substr(tui, 2, length(tui) - 2) AS tui, price, date, new_build = 'N' AS new,
               duration = 'F' AS freehold, ppd_cat, concat(paon, saon, postcode) AS houseid,
               paon, saon, postcode, property_type AS type, street, town, district, county,
               split_part(postcode, ' ', 1) AS outcode, substr(postcode, 1, 2) AS area,
               concat(split_part(postcode, ' ', 1), ' ', substr(split_part(postcode, ' ', 2), 1, 1)) AS sector,
               CASE record_status WHEN 'A' THEN 'ADDITION' WHEN 'C' THEN 'CHANGE' ELSE 'DELETE' END AS row_class
        FROM raw
        WHERE regexp_full_match(postcode, '[A-Za-z]{1,2}[0-9][0-9A-Za-z]? [0-9][A-Za-z]{2}')"""),
    "kept": (("good",), "SELECT * FROM good WHERE row_class <> 'DELETE'"),
    "users": ((), "SELECT c_custkey AS user_id FROM customer"),
    "used": ((), """
        SELECT CAST(event_id AS VARCHAR) AS id, user_id, event_type AS api_route, ts AS timestamp,
               CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 5 END AS BIGINT) AS tokens,
               CASE WHEN ts < TIMESTAMP '2024-01-08' THEN concat('old-', user_id) END AS ledger_id
        FROM events WHERE event_type IN ('view', 'click', 'purchase')"""),
    "opened": (("used",), """
        SELECT * FROM used WHERE ledger_id IS NULL AND timestamp <= TIMESTAMP '2024-01-20'"""),
    "rolled": (("opened",), """
        SELECT sha256(concat('ledger|', user_id, '|', epoch_us(TIMESTAMP '2024-01-20'))) AS id, user_id,
               CAST(sum(tokens) AS BIGINT) AS total_tokens, min(timestamp) AS period_start,
               max(timestamp) AS period_end
        FROM opened GROUP BY user_id"""),
    "marked": (("used", "rolled"), """
        SELECT u.id, u.user_id, u.api_route, u.timestamp, u.tokens, coalesce(u.ledger_id, r.id) AS ledger_id
        FROM used u LEFT JOIN rolled r
          ON u.user_id = r.user_id AND u.timestamp <= r.period_end AND u.ledger_id IS NULL"""),
    "levels": (("postcodes",), "\nUNION ALL ".join(
        f"SELECT postcode, '{t}' AS area_type, {t} AS area FROM postcodes" for t in AREA_TYPES
    )),
    "frame": (("houses", "sales", "postcodes"), """
        SELECT s.price, s.date, h.type, h.paon, h.saon, h.postcode, p.street, p.town, p.county, h.houseid, s.tui
        FROM postcodes p JOIN houses h ON p.postcode = h.postcode
        JOIN sales s ON h.houseid = s.houseid AND h.type <> 'O'
        WHERE s.ppd_cat = 'A'"""),
    "ranged": (("frame",), """
        SELECT * FROM frame WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'"""),
    "placed": (("frame", "levels"), """
        SELECT l.area_type, l.area, f.type, f.price, f.date, f.houseid, f.tui
        FROM frame f JOIN levels l ON f.postcode = l.postcode"""),
    "labelled": (("placed",), """
        SELECT area_type, area, type, price, date, houseid, tui FROM placed
        UNION ALL SELECT area_type, area, 'all', price, date, houseid, tui FROM placed"""),
    "grains": ((), """
        SELECT * FROM (VALUES ('monthly', 1), ('quarterly', 3), ('half_year', 6), ('yearly', 12)) g(grain, months)"""),
    "cells": (("labelled", "grains"), """
        SELECT area_type, area, type, grain, months,
               make_date(year(date), CAST(floor((month(date) - 1) / months) * months + 1 AS BIGINT), 1) AS period,
               count(*) AS sold, CAST(coalesce(sum(price), 0) AS BIGINT) AS volume,
               CAST(sum(price) AS DOUBLE) / count(price) AS price
        FROM labelled CROSS JOIN grains GROUP BY ALL"""),
    "grid": (("cells",), """
        SELECT area_type, area, type, grain,
               CAST(unnest(generate_series(min(period), max(period), to_months(CAST(months AS INT)))) AS DATE) AS period
        FROM cells GROUP BY area_type, area, type, grain, months"""),
    "filled": (("grid", "cells"), """
        SELECT g.area_type, g.area, g.type, g.grain, g.period, c.sold, c.volume, c.price
        FROM grid g LEFT JOIN cells c USING (area_type, area, type, grain, period)"""),
    "gaps": (("labelled",), """
        SELECT area_type, area, type,
               epoch_us(date) - lag(epoch_us(date)) OVER (
                   PARTITION BY area_type, area, type, houseid ORDER BY date) AS gap
        FROM labelled"""),
    "tenancy": (("gaps",), """
        SELECT area_type, area, type,
               CAST(sum(gap) AS DOUBLE) / count(gap) / 86400000000.0 AS avg_days
        FROM gaps GROUP BY area_type, area, type HAVING count(gap) > 0 OR type = 'all'"""),
    "means": (("labelled",), """
        SELECT area_type, area, type, CAST(sum(price) AS DOUBLE) / count(price) AS mean_price
        FROM labelled GROUP BY area_type, area, type"""),
    "spreads": (("labelled",), """
        SELECT area_type, area, type, round(stddev_samp(price), 4) AS std_price
        FROM labelled GROUP BY area_type, area, type"""),
    "changes": (("filled",), """
        SELECT area_type, area, type, grain, period, (price / lag(price, CASE grain WHEN 'monthly' THEN 12
                   WHEN 'quarterly' THEN 4 WHEN 'half_year' THEN 2 ELSE 1 END) OVER (
                   PARTITION BY area_type, area, type, grain ORDER BY period) - 1) * 100 AS pct_change
        FROM filled"""),
    "counted": (("filled",), """
        SELECT area_type, area, type, strftime(period, '%Y-%m-%d') AS period, sold AS count
        FROM filled WHERE grain = 'monthly'"""),
    "volumes": (("filled",), """
        SELECT area_type, area, type, grain, strftime(period, '%Y-%m-%d') AS period, volume
        FROM filled WHERE type = 'all' OR sold IS NOT NULL"""),
    "epcs": (("houses", "lookup", "certificates"), """
        SELECT h.houseid, c.* FROM houses h JOIN lookup l ON h.houseid = l.houseid
        JOIN certificates c ON c.uprn = l.uprn"""),
    "days": (("used",), """
        SELECT CAST(timestamp AS DATE) AS day, * FROM used"""),
}


def _with(names: tuple[str, ...], body: str) -> str:
    """The body behind the named table expressions and all they rest on."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][0]:
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    listed = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in wanted)
    return f"WITH {listed}\n{body.strip()}"


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


def _first(table: str, key: str, columns: str) -> str:
    """First row of each key by date, then transaction."""
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date, tui) AS n "
        f"FROM {table}) WHERE n = 1"
    )


def _choice(position: int, kind: str) -> str:
    texts = RAW_TEXTS[kind.split("(")[0]]
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"list_extract([{listed}], CAST((o_orderkey + {position}) % {len(texts)} + 1 AS INT))"


def _certificate_column(position: int, field: str, kind: str) -> str:
    if kind == "key":
        return "concat('epc-', o_orderkey) AS lmk_key"
    text = _choice(position, kind)
    name = schemas.CERTIFICATE_RENAMES.get(field, field)
    if kind == "text":
        value = f"CASE WHEN trim({text}) <> '' THEN {text} END"
    elif kind == "rating":
        value = f"CASE WHEN upper(trim({text})) IN ('A','B','C','D','E','F','G') THEN upper(trim({text})) END"
    elif kind in ("int", "bigint"):
        whole = f"regexp_full_match(trim({text}), '[+-]?[0-9]+')"
        value = f"CASE WHEN {whole} THEN try_cast(trim({text}) AS {kind}) END"
    elif kind in ("date", "datetime"):
        shown = "%Y-%m-%d" if kind == "date" else "%Y-%m-%d %H:%M:%S.%f"
        value = f"strftime(try_strptime({text}, '%Y-%m-%d'), '{shown}')"
    else:
        value = f"CAST(try_cast(trim({text}) AS {kind}) AS DOUBLE)"
    return f"{value} AS {name}"


def _typed_certificates() -> str:
    columns = ",\n".join(
        _certificate_column(i, field, kind) for i, (field, kind) in enumerate(schemas.CERTIFICATE_FIELDS)
    )
    return f"SELECT {columns} FROM orders"


def _loaded_sales() -> str:
    columns = f"tui, price, {_time('date')}, new, freehold, ppd_cat, houseid"
    return _with(("kept",), _first("kept", "tui", columns))


SQL: dict[str, str] = {
    "sales_extract": _with(("ranged",), f"""
        SELECT price, {_time('date')}, type, paon, saon, postcode, street, town, houseid FROM ranged"""),
    "sales_of_area": _with(("ranged",), """
        SELECT price, strftime(date, '%Y-%m-%d') AS date, type, paon, saon, postcode, street, town, houseid
        FROM ranged WHERE county = 'County 1'"""),
    "mean_price": _with(("means",), "SELECT * FROM means"),
    "std_house_price": _with(("spreads",), "SELECT * FROM spreads"),
    "most_expensive_sale": _with(("placed",), """
        SELECT area_type, area, type, max(price) AS max_price FROM placed GROUP BY ALL"""),
    "count_house_types": _with(("labelled",), """
        SELECT area_type, area, type, count(DISTINCT houseid) AS count FROM labelled GROUP BY ALL"""),
    "avg_house_tenancy": _with(("tenancy",), "SELECT * FROM tenancy"),
    "count_price": _with(("counted",), "SELECT * FROM counted"),
    "count_price_wide": _with(("counted",), """
        SELECT area_type, area, period, max(count) FILTER (type = 'all') AS n_all,
               max(count) FILTER (type = 'D') AS n_d, max(count) FILTER (type = 'S') AS n_s,
               max(count) FILTER (type = 'T') AS n_t, max(count) FILTER (type = 'F') AS n_f
        FROM counted GROUP BY area_type, area, period"""),
    "sale_volume": _with(("volumes",), "SELECT * FROM volumes"),
    "pct_change_price": _with(("changes",), """
        SELECT area_type, area, type, grain, strftime(period, '%Y-%m-%d') AS period,
               round(pct_change, 6) AS pct_change FROM changes"""),
    "stats_bundle": _with(("means", "spreads", "placed", "labelled", "tenancy", "counted", "volumes", "changes"), """
        SELECT statistic, area_type, area, grain, period, type, round(value, 4) AS value FROM (
            SELECT 'mean_price' AS statistic, area_type, area, NULL AS grain, NULL AS period, type,
                   mean_price AS value FROM means
            UNION ALL SELECT 'std_house_price', area_type, area, NULL, NULL, type, std_price FROM spreads
            UNION ALL SELECT 'most_expensive_sale', area_type, area, NULL, NULL, type, CAST(max(price) AS DOUBLE)
                FROM placed GROUP BY area_type, area, type
            UNION ALL SELECT 'count_house_types', area_type, area, NULL, NULL, type,
                CAST(count(DISTINCT houseid) AS DOUBLE) FROM labelled GROUP BY area_type, area, type
            UNION ALL SELECT 'avg_house_tenancy', area_type, area, NULL, NULL, type, avg_days FROM tenancy
            UNION ALL SELECT 'count_price', area_type, area, 'monthly', period, type, CAST(count AS DOUBLE) FROM counted
            UNION ALL SELECT 'sale_volume', area_type, area, grain, period, type, CAST(volume AS DOUBLE) FROM volumes
            UNION ALL SELECT 'pct_change_price', area_type, area, grain, strftime(period, '%Y-%m-%d'), type,
                pct_change FROM changes)"""),
    "frame_statistics": _with(("houses", "sales", "postcodes"), """
        , open_frame AS (
            SELECT p.county, h.type, h.houseid, s.price, s.date FROM postcodes p
            JOIN houses h ON p.postcode = h.postcode JOIN sales s ON h.houseid = s.houseid
            WHERE h.type <> 'O' AND s.ppd_cat = 'A'),
        every AS (SELECT * FROM open_frame UNION ALL SELECT county, 'all', houseid, price, date FROM open_frame),
        steps AS (SELECT county, type, epoch_us(date) - lag(epoch_us(date)) OVER (
            PARTITION BY county, type, houseid ORDER BY date) AS gap FROM every)
        SELECT county, type, statistic, round(value, 6) AS value FROM (
            SELECT county, type, 'mean_price' AS statistic, CAST(sum(price) AS DOUBLE) / count(price) AS value
            FROM every GROUP BY county, type
            UNION ALL SELECT county, type, 'count_house_types', CAST(count(DISTINCT houseid) AS DOUBLE)
            FROM every GROUP BY county, type
            UNION ALL SELECT county, type, 'avg_house_tenancy',
                CAST(sum(gap) AS DOUBLE) / count(gap) / 86400000000.0
            FROM steps GROUP BY county, type HAVING count(gap) > 0 OR type = 'all')"""),
    "stats_nested": _with(("counted",), """
        SELECT area_type, area,
               concat('{', string_agg(concat('"', period, '":{', types, '}'), ',' ORDER BY period), '}') AS result
        FROM (SELECT area_type, area, period,
                     string_agg(concat('"', type, '":', coalesce(CAST(count AS VARCHAR), 'null')), ','
                                ORDER BY type) AS types
              FROM counted GROUP BY area_type, area, period)
        GROUP BY area_type, area"""),
    "stats_report": _with(("placed", "labelled", "counted", "volumes"), """
        , longest AS (
            SELECT 'most_expensive_sale' AS statistic, area_type, area, type, max(price) AS value
            FROM placed GROUP BY area_type, area, type
            UNION ALL SELECT 'count_house_types', area_type, area, type, count(DISTINCT houseid)
            FROM labelled GROUP BY area_type, area, type),
        typed AS (
            SELECT area_type, area, grain, period,
                   concat('"', period, '":{', string_agg(concat('"', type, '":',
                       coalesce(CAST(volume AS VARCHAR), 'null')), ',' ORDER BY type), '}') AS part
            FROM volumes GROUP BY area_type, area, grain, period),
        grained AS (
            SELECT area_type, area, grain,
                   concat('"', grain, '":{', string_agg(part, ',' ORDER BY period), '}') AS part
            FROM typed GROUP BY area_type, area, grain),
        monthly AS (
            SELECT area_type, area, period,
                   concat('"', period, '":{', string_agg(concat('"', type, '":',
                       coalesce(CAST(count AS VARCHAR), 'null')), ',' ORDER BY type), '}') AS part
            FROM counted GROUP BY area_type, area, period)
        SELECT area_type, area, statistic, result, CAST(NULL AS VARCHAR) AS start_date, CAST(NULL AS VARCHAR) AS end_date FROM (
            SELECT area_type, area, statistic,
                   concat('{', string_agg(concat('"', type, '":', value), ',' ORDER BY type), '}') AS result
            FROM longest GROUP BY area_type, area, statistic
            UNION ALL SELECT area_type, area, 'sale_volume',
                   concat('{', string_agg(part, ',' ORDER BY grain), '}') FROM grained GROUP BY area_type, area
            UNION ALL SELECT area_type, area, 'count_price',
                   concat('{', string_agg(part, ',' ORDER BY period), '}') FROM monthly GROUP BY area_type, area)"""),
    "sale_gaps": _with(("frame",), f"""
        , dates AS (SELECT houseid, type, date, count(*) AS sales FROM frame GROUP BY houseid, type, date)
        SELECT houseid, type, {_time('date')}, sales, CAST(epoch_us(date) - lag(epoch_us(date)) OVER (
            PARTITION BY houseid, type ORDER BY date) AS DOUBLE) / 86400000000.0 AS days_since
        FROM dates"""),
    "stats_store": _with(("means",), """
        SELECT replace(upper(concat(area_type, '_', area, ':0001-01-01 00:00:00-9999-12-31 23:59:59.999999')), ' ', '')
                   AS data_id, area_type, area, type, mean_price FROM means"""),
    "area_statistics": _with(("means", "labelled", "tenancy"), """
        SELECT type, 'mean_price' AS statistic, round(mean_price, 6) AS value FROM means
        WHERE area_type = 'county' AND area = 'County 1'
        UNION ALL SELECT type, 'count_house_types', CAST(count(DISTINCT houseid) AS DOUBLE) FROM labelled
        WHERE area_type = 'county' AND area = 'County 1' GROUP BY type
        UNION ALL SELECT type, 'avg_house_tenancy', round(avg_days, 6) FROM tenancy
        WHERE area_type = 'county' AND area = 'County 1'"""),
    "house_by_key": _with(("houses",), """
        SELECT houseid, paon, saon, postcode, type FROM houses
        WHERE houseid = (SELECT CAST(max(CAST(houseid AS BIGINT)) AS VARCHAR) FROM houses)"""),
    "ledger_of_user": _with(("rolled",), """
        SELECT id, user_id, total_tokens FROM rolled WHERE user_id = (SELECT min(user_id) FROM rolled)"""),
    "stats_cached": _with(("means",), """
        SELECT "case", area_type, area, type, mean_price + shift AS mean_price FROM means
        CROSS JOIN (VALUES ('first', 0), ('again', 0), ('new data', 2)) c("case", shift)
        UNION ALL
        SELECT 'capitals', area_type, upper(area), type,
               mean_price + CASE WHEN area = upper(area) THEN 0 ELSE 3 END FROM means"""),
    "snapshot_changed": _with(("sales",), """
        SELECT against, (SELECT count(*) FROM sales) AS rows, changed FROM (VALUES
            ('same', false), ('prices one higher', true), ('a column null', true)) c(against, changed)"""),
    "snapshot_parts": _with(("sales",), """
        SELECT CAST(year(date) AS INT) AS part, CASE year(date) WHEN 1996 THEN 'removed' WHEN 1998 THEN 'added' ELSE 'changed' END AS change,
               CASE WHEN year(date) <> 1996 THEN count(*) END AS sales, true AS adds_up, true AS differs
        FROM sales GROUP BY year(date)
        HAVING year(date) IN (1996, 1998) OR (year(date) IN (1993, 1995) AND count(*) FILTER (tui LIKE '%0') > 0)"""),
    "data_id_keys": _with(("levels",), """
        SELECT DISTINCT area_type, area,
               replace(upper(concat(area_type, '_', area, ':1996-01-01 00:00:00-2000-12-31 00:00:00')), ' ', '')
                   AS data_id,
               replace(upper(concat(area_type, '_', area, ':0001-01-01 00:00:00-9999-12-31 23:59:59.999999')), ' ', '')
                   AS open_data_id
        FROM levels WHERE area IS NOT NULL"""),
    "stats_requests": """
        SELECT statistic, count(*) AS requests,
               statistic IN ('mean_price', 'sale_volume', 'count_price') AS supported,
               CASE statistic WHEN 'mean_price' THEN 'Average sale price'
                    WHEN 'sale_volume' THEN 'Total sales volume for time periods 1mo, 3mo, 6mo, and 12mo'
                    WHEN 'count_price' THEN 'Count the total sales' END AS description
        FROM (SELECT CASE event_type WHEN 'view' THEN 'mean_price' WHEN 'click' THEN 'sale_volume'
                          WHEN 'purchase' THEN 'median_price' WHEN 'signup' THEN 'count_price'
                          ELSE event_type END AS statistic FROM events)
        GROUP BY statistic""",
    "stats_requests_rejected": """
        SELECT user_id, event_type AS statistic, count(*) AS requests
        FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type""",
    "houses_by_postcode": _with(("houses",), "SELECT houseid, paon, saon, postcode, type FROM houses"),
    "house_street": _with(("houses", "postcodes"), """
        SELECT houseid, paon, saon, h.postcode, type, street
        FROM houses h LEFT JOIN postcodes p ON h.postcode = p.postcode"""),
    "house_sales": _with(("houses", "sales"), f"""
        SELECT tui, price, {_time('date')}, new, freehold, ppd_cat, houseid
        FROM sales WHERE houseid IN (SELECT houseid FROM houses)"""),
    "linked_epcs": _with(("epcs",), """
        SELECT houseid, lmk_key, address1, address2, address3, postcode, current_energy_rating,
               potential_energy_rating, property_type, strftime(lodgement_date, '%Y-%m-%d') AS lodgement_date,
               CAST(total_floor_area AS DOUBLE) AS total_floor_area, uprn
        FROM epcs"""),
    "house_detail": _with(("houses", "postcodes", "sales", "epcs"), """
        , sold AS (
            SELECT houseid, year(date) AS year, count(*) AS n, string_agg(concat_ws(':', tui, price,
                   strftime(date, '%Y-%m-%d'), new, freehold, ppd_cat), '|' ORDER BY date DESC, tui) AS listed
            FROM sales GROUP BY houseid, year(date)),
        linked AS (
            SELECT houseid, year(lodgement_date) AS year, count(*) AS n, string_agg(concat_ws(':', lmk_key,
                   current_energy_rating, potential_energy_rating, strftime(lodgement_date, '%Y-%m-%d'),
                   total_floor_area, uprn), '|' ORDER BY lmk_key) AS listed
            FROM epcs GROUP BY houseid, year(lodgement_date)),
        years AS (SELECT houseid, year FROM sold UNION SELECT houseid, year FROM linked)
        SELECT h.houseid, CAST(y.year AS INT) AS year, paon, saon, street, h.postcode, type,
               CAST(coalesce(s.n, 0) AS INT) AS n_sales, CAST(coalesce(l.n, 0) AS INT) AS n_epcs,
               coalesce(s.listed, '') AS sales, coalesce(l.listed, '') AS epcs
        FROM houses h LEFT JOIN postcodes p ON h.postcode = p.postcode
        LEFT JOIN years y ON h.houseid = y.houseid
        LEFT JOIN sold s ON y.houseid = s.houseid AND y.year IS NOT DISTINCT FROM s.year
        LEFT JOIN linked l ON y.houseid = l.houseid AND y.year IS NOT DISTINCT FROM l.year"""),
    "usage_priced": _with(("used",), f"""
        SELECT id, user_id, api_route, {_time('timestamp')}, tokens, ledger_id FROM used"""),
    "usage_window": _with(("used",), f"""
        SELECT user_id, api_route, tokens, {_time('timestamp')} FROM used
        WHERE used.timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15 12:00:00'"""),
    "usage_trends": _with(("days",), """
        SELECT user_id, strftime(day, '%Y-%m-%d') AS date, CAST(sum(tokens) AS BIGINT) AS tokens,
               count(*) AS requests
        FROM days WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'
        GROUP BY user_id, day"""),
    "usage_summary": _with(("users", "used"), """
        SELECT u.user_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, count(id) AS total_requests,
               CASE WHEN count(id) > 0
                    THEN CAST(printf('%.2f', CAST(sum(tokens) AS DOUBLE) / count(id)) AS DOUBLE)
                    ELSE 0.0 END AS average_tokens_per_request,
               CAST(7 AS INT) AS period_days
        FROM users u LEFT JOIN used e ON u.user_id = e.user_id AND e.timestamp >= TIMESTAMP '2024-01-18'
        GROUP BY u.user_id"""),
    "top_routes": _with(("used",), """
        SELECT user_id, route, tokens, requests FROM (
            SELECT user_id, api_route AS route, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests,
                   row_number() OVER (PARTITION BY user_id ORDER BY sum(tokens) DESC, api_route) AS n
            FROM used WHERE timestamp >= TIMESTAMP '2023-12-26' GROUP BY user_id, api_route)
        WHERE n <= 10"""),
    "top_routes_overall": _with(("used",), """
        SELECT api_route AS route, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests
        FROM used WHERE timestamp >= TIMESTAMP '2023-12-26' GROUP BY api_route
        ORDER BY tokens DESC, route LIMIT 10"""),
    "current_period_tokens": _with(("users", "used"), """
        SELECT u.user_id, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS current_period_tokens,
               '2023-12-31 00:00:00.000000' AS period_start, '2024-01-28 00:00:00.000000' AS period_end
        FROM users u LEFT JOIN used e ON u.user_id = e.user_id
         AND e.timestamp BETWEEN TIMESTAMP '2023-12-31' AND TIMESTAMP '2024-01-28'
        GROUP BY u.user_id"""),
    "billing_history": _with(("used",), f"""
        , ledgers AS (
            SELECT concat('week-', CAST(date_trunc('week', timestamp) AS DATE), '-', user_id) AS id, user_id,
                   CAST(sum(tokens) AS BIGINT) AS total_tokens, min(timestamp) AS period_start,
                   max(timestamp) AS period_end
            FROM used GROUP BY user_id, date_trunc('week', timestamp))
        SELECT id, user_id, total_tokens, {_time('period_start')}, {_time('period_end')}, position FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY period_end DESC, id) AS INT) AS position
            FROM ledgers)
        WHERE position <= 3"""),
    "users_with_usage": _with(("users", "used"), """
        SELECT DISTINCT u.user_id FROM users u JOIN used e ON u.user_id = e.user_id
        WHERE e.timestamp <= TIMESTAMP '2024-01-20'"""),
    "ledger_rollup": _with(("rolled",), f"""
        SELECT id, user_id, total_tokens, {_time('period_start')}, {_time('period_end')},
               '2024-01-25 00:00:00.000000' AS timestamp, CAST(NULL AS VARCHAR) AS stripe_event_id,
               sha256(concat('event|', epoch_us(TIMESTAMP '2024-01-20'))) AS aggregation_event_id
        FROM rolled"""),
    "ledgers_listed": _with(("rolled",), "SELECT id, user_id, total_tokens FROM rolled"),
    "usage_stamped": _with(("marked",), "SELECT id, user_id, tokens, ledger_id FROM marked"),
    "usage_stamped_by_join": _with(("marked",), "SELECT id, user_id, tokens, ledger_id FROM marked"),
    "ledger_items": _with(("rolled", "marked"), f"""
        SELECT ledger_id, r.user_id, m.id AS usage_id, api_route, tokens, {_time('timestamp')}
        FROM rolled r JOIN marked m ON r.id = m.ledger_id"""),
    "billing_run": _with(("rolled", "marked"), """
        SELECT r.id, r.user_id, r.total_tokens, count(*) AS items, CAST(sum(m.tokens) AS BIGINT) AS item_tokens
        FROM rolled r JOIN marked m ON r.id = m.ledger_id GROUP BY r.id, r.user_id, r.total_tokens"""),
    "billing_late_usage": _with(("opened",), """
        , billed AS (SELECT *, sha256(concat('ledger|', user_id, '|', epoch_us(TIMESTAMP '2024-01-20'),
            CASE WHEN id LIKE '%7' THEN '|1' ELSE '' END)) AS ledger FROM opened)
        SELECT ledger AS id, user_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS items,
               CAST(sum(tokens) AS BIGINT) AS item_tokens, true AS timed
        FROM billed GROUP BY ledger, user_id"""),
    "usage_settled": _with(("marked",), """
        SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens,
               count(ledger_id) AS billed, count(DISTINCT ledger_id) AS ledgers, CAST(1 AS BIGINT) AS files
        FROM marked GROUP BY strftime(timestamp, '%Y-%m-%d')"""),
    "ppd_normalise": _with(("good",), f"""
        SELECT tui, price, {_time('date')}, new, freehold, ppd_cat, houseid, paon, saon, postcode, type, street,
               town, district, county, outcode, area, sector, row_class FROM good"""),
    "ppd_rejects": _with(("raw",), """
        SELECT substr(tui, 2, length(tui) - 2) AS tui, postcode, 'postcode' AS reason
        FROM raw WHERE postcode = 'BAD CODE'"""),
    "ppd_status_split": _with(("good",), """
        SELECT tui, row_class, CASE WHEN row_class = 'DELETE' THEN 'deletions' ELSE 'additions' END AS side
        FROM good"""),
    "ppd_upsert_postcodes": _with(("kept",), _first(
        "kept", "postcode", "postcode, street, town, district, county, outcode, area, sector")),
    "ppd_upsert_houses": _with(("kept",), _first("kept", "houseid", "houseid, paon, saon, postcode, type")),
    "ppd_upsert_sales": _loaded_sales(),
    "ppd_apply_changes": _with(("good",), f"""
        SELECT tui, CASE WHEN row_class = 'CHANGE' THEN price ELSE price - 1000 END AS price, {_time('date')},
               NOT new AS new, freehold, ppd_cat, houseid
        FROM good WHERE row_class <> 'DELETE'"""),
    "keyed_insert_pruned": _loaded_sales(),
    "ppd_file_load": _loaded_sales(),
    "ppd_stream_ingest": _loaded_sales(),
    "ppd_stream_dedup": _loaded_sales(),
    "ppd_stream_changes": _with(("good",), f"""
        , listed AS (
            SELECT *, row_number() OVER (PARTITION BY number // 8 ORDER BY number % 5, number) AS turn
            FROM (SELECT *, CAST(tui AS BIGINT) AS number FROM good)),
        last AS (
            SELECT *, coalesce(max(CASE WHEN row_class <> 'ADDITION' THEN turn END) OVER (PARTITION BY number // 8), 0) AS since
            FROM listed),
        first AS (
            SELECT *, row_number() OVER (PARTITION BY number // 8 ORDER BY turn) AS place
            FROM last WHERE turn >= since AND row_class <> 'DELETE')
        SELECT CAST(number // 8 AS VARCHAR) AS tui, price, {_time('date')}, NOT new AS new, freehold, ppd_cat, houseid
        FROM first WHERE place = 1"""),
    "epc_typed": _typed_certificates(),
    "epc_file_load": _typed_certificates(),
    "load_skipped": _with(("kept",), """
        , parts AS (SELECT count(*) AS whole, count(*) FILTER (substr(tui, -1, 1) IN ('1', '2', '3', '4', '5')) AS part FROM kept)
        SELECT step, loaded, true AS noted, CASE WHEN of_part THEN part ELSE whole END AS sales FROM parts
        CROSS JOIN (VALUES ('first', true, true), ('again', false, true), ('more', true, false), ('more again', false, false)) s(step, loaded, of_part)"""),
    "record_flags": _with(("raw",), """
        SELECT tui, CASE new_build WHEN 'Y' THEN true WHEN 'N' THEN false END AS new_build, CAST(NULL AS BOOLEAN) AS duration FROM raw"""),
    "epc_upsert": f"""
        SELECT lmk_key, current_energy_rating, current_energy_efficiency,
               CASE WHEN current_energy_rating = 'A' THEN 'known' ELSE tenure END AS tenure, uprn
        FROM ({_typed_certificates()})""",
    "usage_stream_daily": _with(("days",), """
        SELECT strftime(day, '%Y-%m-%d') AS date, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests
        FROM days GROUP BY day"""),
    "usage_stream_windowed": _with(("used",), """
        , chunked AS (SELECT *, CAST(floor((CAST(timestamp AS DATE) - DATE '2024-01-01') / 8) AS INT)
               + CASE WHEN id LIKE '%7' THEN 1 WHEN id LIKE '%3' THEN 2 ELSE 0 END AS due FROM used),
        dealt AS (SELECT *, least(due, 3) AS delivery, CAST(timestamp AS DATE) AS day FROM chunked),
        marks AS (SELECT k, (SELECT max(timestamp) - INTERVAL 2 DAY FROM dealt WHERE delivery < k) AS mark
                  FROM (SELECT unnest(range(0, 5)) AS k)),
        judged AS (SELECT d.*, coalesce(day + INTERVAL 1 DAY <= mark, false) AS late FROM dealt d JOIN marks ON k = delivery)
        SELECT strftime(day, '%Y-%m-%d') AS date,
               CAST(coalesce(sum(tokens) FILTER (NOT late), 0) AS BIGINT) AS tokens, count(*) FILTER (NOT late) AS requests,
               CAST(coalesce(sum(tokens) FILTER (late), 0) AS BIGINT) AS late_tokens, count(*) FILTER (late) AS late_requests,
               count(*) FILTER (NOT late) > 0 AND day + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE k = 4) AS closed
        FROM judged GROUP BY day"""),
    "usage_stream_append": _with(("used",), """
        SELECT user_id, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM used GROUP BY user_id"""),
}

# The same statistics over the sales as a batch of changes leaves them.
SQL["stats_refreshed"] = SQL["stats_bundle"].replace(
    _CTES["sales"][1],
    _CTES["sales"][1].replace(
        "CAST(round(o_totalprice) AS BIGINT) AS price",
        "CAST(round(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 10 = 2 THEN 1000 ELSE 0 END AS price",
    ) + " WHERE o_orderkey % 10 <> 1",
)
