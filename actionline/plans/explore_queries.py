"""Queries over exploration results and page structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actionline.operators import dom as D
from actionline.operators import explore as X
from actionline.plans.registry import query
from actionline.sources.shared import stored


@query("x01_pass_stats", "v_steps", sql="""SELECT id, count(*) AS trials, count_if(pass_flag)::BIGINT AS passed, round(count_if(pass_flag) / count(*), 6) AS pass_rate,
  coalesce(string_agg(concat(action, '[', element_id, ']'), ' -> ' ORDER BY step_idx) FILTER (WHERE pass_flag), '') AS actions FROM v_steps GROUP BY id""")
def x01(steps: DataFrame) -> DataFrame:
    return X.pass_stats(steps)


@query("x02_element_coverage", "v_steps", sql="SELECT id, count(DISTINCT concat(element_text, ':', element_id)) AS tried, count(DISTINCT CASE WHEN pass_flag THEN concat(element_text, ':', element_id) END) AS passed FROM v_steps GROUP BY id")
def x02(steps: DataFrame) -> DataFrame:
    return X.element_coverage(steps)


@query("x02_coverage_over_runs", "v_steps", sql="""SELECT id, count(DISTINCT concat(element_text, ':', element_id)) AS tried, count(DISTINCT CASE WHEN pass_flag THEN concat(element_text, ':', element_id) END) AS passed, true AS near FROM v_steps GROUP BY id""")
def x02b(steps: DataFrame) -> DataFrame:
    """Sketches of five runs, stored and united, beside the exact counts; near: within the sketches' error bound."""
    sketches = stored(X.coverage_sketches(steps.withColumn("run_id", F.col("step_idx") % 5)), "sketches")
    about = X.coverage_of_sketches(sketches).withColumnsRenamed({"tried": "t", "passed": "p"})
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 4 * X.SKETCH_ERROR * F.col(b))
    return X.element_coverage(steps).join(about, "id").select("id", "tried", "passed", (near("t", "tried") & near("p", "passed")).alias("near"))


@query("x03_run_summary", "v_results", sql="SELECT type, count(*) AS n FROM v_results GROUP BY 1")
def x03(results: DataFrame) -> DataFrame:
    return X.run_summary(results)


@query("x03_failures", "v_results", sql="SELECT target, reason FROM v_results WHERE type = 'fail'")
def x03b(results: DataFrame) -> DataFrame:
    return X.failures(results)


@query("x03_first_results", "v_results", sql="SELECT event_id, target FROM v_results WHERE type = 'success' ORDER BY event_id LIMIT 20")
def x03c(results: DataFrame) -> DataFrame:
    return X.first_results(results).select("event_id", "target")


BOXED = r"bx AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(output, '\\boxed\{([^{}]*)\}', 1), lambda x: trim(x)), lambda x: x <> '') AS b FROM v_verifier)"


@query("x04_extract_boxed", "v_verifier", sql=f"WITH {BOXED} SELECT doc_id, array_to_string(b, '|') AS boxed FROM bx")
def x04(v: DataFrame) -> DataFrame:
    return v.select("doc_id", F.array_join(X.extract_boxed("output"), "|").alias("boxed"))


ACTIONS = rf"""{BOXED}, u AS (SELECT doc_id, unnest(b) AS p, generate_subscripts(b, 1) AS k FROM bx),
a AS (SELECT doc_id, k, regexp_extract(p, '^\s*(click|enter|select|scroll)\s*\[([^\[\]]*)\]?\s*(?:\[([^\[\]]*)\]?)?\s*$', 1) AS action, regexp_extract(p, '^\s*(click|enter|select|scroll)\s*\[([^\[\]]*)\]?\s*(?:\[([^\[\]]*)\]?)?\s*$', 2) AS target,
  regexp_extract(p, '^\s*(click|enter|select|scroll)\s*\[([^\[\]]*)\]?\s*(?:\[([^\[\]]*)\]?)?\s*$', 3) AS value FROM u)"""


@query("x05_parse_actions", "v_verifier", sql=f"WITH {ACTIONS} SELECT doc_id, k::INT AS k, nullif(action, '') AS action, CASE WHEN action <> '' THEN target END AS target, CASE WHEN action <> '' THEN value END AS value FROM a")
def x05(v: DataFrame) -> DataFrame:
    b = v.select("doc_id", F.posexplode(X.extract_boxed("output")).alias("k", "p")).withColumn("a", X.parse_actions("p", "tolerant")[0])
    return b.select("doc_id", (F.col("k") + 1).alias("k"), "a.action", "a.target", "a.value")


@query("x05_parse_nested_actions", "v_verifier")
def x05b(v: DataFrame) -> DataFrame:
    return v.select("doc_id", X.format_actions(X.parse_nested_actions(F.array_join(X.extract_boxed("output"), ","))).alias("actions"))


@query("x05_nested_values", "v_verifier", sql="""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('click[', doc_id % 30, '], enter[', doc_id % 7, '][x[', doc_id % 9, ']y]') WHEN 1 THEN concat('select[a[', doc_id, '[b]]][c]')
  WHEN 2 THEN concat('scroll[down], click[[[', doc_id, ']]]') WHEN 3 THEN concat('enter[1][', doc_id, ', [2], 3]') END AS actions FROM v_verifier""")
def x05c(v: DataFrame) -> DataFrame:
    """Actions whose targets and values hold brackets and commas; an unknown action spoils all."""
    i = lambda n=1 << 62: (F.col("doc_id") % n).cast("string")
    text = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("click["), i(30), F.lit("], enter ["), i(7), F.lit("]['x["), i(9), F.lit("]y'],")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("select[a["), i(), F.lit("[b]]][c]"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit(" scroll[down],click[[["), i(), F.lit("]]]")))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("enter[1]["), i(), F.lit(", [2], 3]"))).otherwise(F.concat(F.lit("click[1],drag["), i(), F.lit("]")))
    )
    return v.select("doc_id", X.format_actions(X.parse_nested_actions(text)).alias("actions"))


@query("x06_format_actions", "v_verifier", sql=f"WITH {ACTIONS}, s AS (SELECT doc_id, bool_and(action <> '') AS ok, string_agg(concat(action, '[', target, ']', CASE WHEN value <> '' THEN concat('[', value, ']') ELSE '' END), ', ' ORDER BY k) AS t FROM a GROUP BY doc_id) SELECT v.doc_id, CASE WHEN ok THEN t END AS actions FROM v_verifier v LEFT JOIN s USING (doc_id)")
def x06(v: DataFrame) -> DataFrame:
    joined = v.withColumn("seq", F.array_join(X.extract_boxed("output"), ","))
    return joined.select("doc_id", X.format_actions(X.parse_actions("seq", "tolerant")).alias("actions"))


#: What v_forms puts before each page, as its nodes (in SQL: the page's own links follow).
@query("x07_page_nodes", "v_forms", "v_links", sql=r"""WITH o AS (SELECT page_id, 0 AS ord, CASE page_id % 5 WHEN 1 THEN 'INPUT' WHEN 2 THEN 'A' WHEN 3 THEN 'SELECT' WHEN 4 THEN 'TEXTAREA' END AS tag,
    CASE page_id % 5 WHEN 2 THEN 'go' WHEN 3 THEN 'onenonethree' WHEN 4 THEN 'a b' ELSE '' END AS text, 'form' AS zone, CASE page_id % 5 WHEN 1 THEN 'v' WHEN 4 THEN 'a b' END AS input_value FROM pages WHERE page_id % 5 > 0
  UNION ALL SELECT page_id, 1, 'BUTTON', 'send', 'form', NULL FROM pages WHERE page_id % 5 = 4
  UNION ALL SELECT page_id, 2 + pos, 'A', trim(text), 'nav', NULL FROM v_links)
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1)::INT AS place, tag, text, zone, input_value, concat(zone, '--') AS address FROM o""")
def x07(forms: DataFrame, links: DataFrame) -> DataFrame:
    nodes = D.page_nodes(forms).where("address is not null")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1
    return nodes.select("page_id", place.alias("place"), "tag", "text", "zone", "input_value", "address")


def _links(links: DataFrame) -> DataFrame:
    return links.select("page_id", F.col("pos").alias("node_id"), F.lit("A").alias("tag"), "text", F.create_map(F.lit("k"), F.col("text")).alias("attrs"), (F.col("pos") % 5 != 4).alias("can_interact"))


@query("x08_nodes_by_tag", "pages", "v_links", sql="SELECT page_id, count(*) AS n, string_agg(text, '|' ORDER BY pos) AS texts FROM v_links GROUP BY page_id")
def x08(pages: DataFrame, links: DataFrame) -> DataFrame:
    n = D.nodes_by_tag(D.page_nodes(pages), "a")
    return n.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "|").alias("texts"))


@query("x08_nodes_by_id", "v_links", sql="SELECT page_id, pos AS node_id, text FROM v_links WHERE pos = page_id % 6")
def x08b(links: DataFrame) -> DataFrame:
    n = _links(links)
    return D.nodes_by_id(n, n.select("page_id", (F.col("page_id") % 6).cast("int").alias("node_id")).distinct()).select("page_id", "node_id", "text")


@query("x08_select_values", "v_selects", sql="SELECT page_id, concat('one ', page_id, '|none ', length(coalesce(url, '')), '|three') AS texts, concat(page_id % 4, '|none ', length(coalesce(url, '')), '|three') AS vals FROM pages")
def x08c(forms: DataFrame) -> DataFrame:
    o = D.options_of(D.page_nodes(forms))
    return D.select_values(o).join(D.select_values(o.withColumn("value", F.lit(""))).withColumnRenamed("values", "texts"), ["page_id", "node_id"]).select("page_id", F.array_join("texts", "|").alias("texts"), F.array_join("values", "|").alias("vals"))


@query("x08_can_operate", "v_forms", sql=r"""SELECT page_id, regexp_matches(h, '<select|<textarea|<input type="text"') AS has_form, regexp_matches(h, '<a href|<button') AS has_click FROM (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>', '', 'g') AS h FROM v_forms)
  WHERE regexp_matches(h, '<select|<textarea|<input type="text"|<a href|<button')""")
def x08d(forms: DataFrame) -> DataFrame:
    return D.can_operate(D.page_nodes(forms))


@query("x09_distinct_clickables", "v_links", sql="SELECT page_id, text, min(pos) AS node_id FROM (SELECT page_id, trim(text) AS text, pos FROM v_links WHERE pos % 5 <> 4) GROUP BY ALL")
def x09(links: DataFrame) -> DataFrame:
    return D.distinct_clickables(_links(links)).select("page_id", F.trim("text").alias("text"), "node_id")


@query("x10_dedup_states", "v_links", sql="SELECT min(page_id) AS page_id FROM (SELECT page_id, string_agg(concat(pos, text), '|' ORDER BY pos) AS s FROM v_links GROUP BY page_id) GROUP BY s")
def x10(links: DataFrame) -> DataFrame:
    return D.dedup_states(D.state_hash(_links(links), "node_id", "text")).select("page_id")


@query("x10_dedup_seen_states", "v_links", sql="WITH st AS (SELECT page_id, string_agg(concat(pos, text), '|' ORDER BY pos) AS s FROM v_links GROUP BY page_id) SELECT min(page_id) AS page_id FROM st WHERE s NOT IN (SELECT s FROM st WHERE page_id % 10 = 0) GROUP BY s")
def x10b(links: DataFrame) -> DataFrame:
    states = D.state_hash(_links(links), "node_id", "text")
    return D.dedup_states(states, states.where("page_id % 10 = 0"), large=True).select("page_id")


@query("x11_rematch", "v_links", sql="""WITH n AS (SELECT page_id - 1 AS page_id, pos * 2 AS node_id, text, CASE WHEN pos % 2 = 0 THEN 'A' ELSE 'BUTTON' END AS tag FROM v_links WHERE page_id > 0), a AS (SELECT page_id, pos AS node_id, text, 'A' AS tag FROM v_links)
  SELECT a.page_id, a.node_id AS old_id, coalesce((SELECT min(n.node_id) FROM n WHERE n.page_id = a.page_id AND n.text = a.text AND n.tag = a.tag), (SELECT min(n.node_id) FROM n WHERE n.page_id = a.page_id AND n.text = a.text)) AS new_id
  FROM a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.page_id = a.page_id AND n.node_id = a.node_id)""")
def x11(links: DataFrame) -> DataFrame:
    nodes = links.where("page_id > 0").select((F.col("page_id") - 1).alias("page_id"), (F.col("pos") * 2).alias("node_id"), "text", F.when(F.col("pos") % 2 == 0, "A").otherwise("BUTTON").alias("tag"))
    return D.rematch(_links(links).select("page_id", "node_id", "text", "tag"), nodes)


CHANGES = """vc AS (SELECT n.* FROM v_snap_new n WHERE NOT EXISTS (SELECT 1 FROM v_snap_old o WHERE o.page_id = n.page_id AND o.text = n.text AND o.tag = n.tag AND abs(o.x - n.x) <= 2 AND abs(o.y - n.y) <= 2 AND abs(o.w - n.w) <= 2 AND abs(o.h - n.h) <= 2))"""


@query("x12_visual_changes", "v_snap_old", "v_snap_new", sql=f"WITH {CHANGES} SELECT * FROM vc")
def x12(old: DataFrame, new: DataFrame) -> DataFrame:
    return D.visual_changes(old, new)


@query("x12_crowded_texts", "v_snap_old", "v_snap_new", sql=f"WITH {CHANGES} SELECT * FROM vc")
def x12b(old: DataFrame, new: DataFrame) -> DataFrame:
    return D.visual_changes(old, new, crowd=3)  # nearly every stripe is cut by all four measures


@query("x13_change_clusters", "v_snap_old", "v_snap_new", sql=f"""WITH {CHANGES}, o AS (SELECT *, y - lag(y + h) OVER (PARTITION BY page_id ORDER BY y, el) AS gap FROM vc WHERE y + h < -100 OR y > 820),
  c AS (SELECT *, sum(CASE WHEN gap >= 360 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y, el) AS cluster FROM o)
  SELECT page_id, cluster::BIGINT AS cluster, count(*) AS n, min(y) AS top, max(y + h) AS bottom, (min(y) + max(y + h)) / 2 AS centre, greatest(0, (min(y) + max(y + h)) / 2 - 360) AS scroll_to FROM c GROUP BY page_id, cluster""")
def x13(old: DataFrame, new: DataFrame) -> DataFrame:
    return D.change_clusters(D.visual_changes(old, new))


@query("x14_safe_url_name", "pages", sql=r"SELECT page_id, concat(substr(regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g'), 1, 30), '_', substr(md5(url), 1, 8)) AS name FROM pages")
def x14(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", X.safe_url_name(F.col("url")).alias("name"))


@query("x14_clean_label", "v_links", sql=r"SELECT page_id, pos, regexp_replace(text, '[^\p{L}\p{Nd}_-]', '', 'g') AS label FROM v_links")
def x14b(links: DataFrame) -> DataFrame:
    return links.select("page_id", "pos", X.clean_label(F.col("text")).alias("label"))


@query("x14_sequence_names", "v_links", sql="""WITH l AS (SELECT page_id, pos, text, string_agg(text, '_') OVER (PARTITION BY page_id ORDER BY pos) AS name FROM v_links), b AS (SELECT *, max(octet_length(encode(name))) OVER (PARTITION BY page_id) > 40 AS far FROM l)
  SELECT page_id, pos, CASE WHEN far THEN concat('step_', pos + 1) ELSE name END AS name FROM b""")
def x14c(links: DataFrame) -> DataFrame:
    l = links.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("l")).select("page_id", F.transform("l", lambda x: x["text"]).alias("labels"))
    return l.select("page_id", F.posexplode(X.sequence_names(F.col("labels"), 40)).alias("pos", "name"))
