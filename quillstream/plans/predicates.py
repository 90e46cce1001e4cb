"""Queries of projections, filters and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup, select
from .catalog import epoch, register, t

@register("""SELECT o_orderkey AS record_id, o_custkey AS owner, 'order' AS record_type, round(o_totalprice / 1000, 3) AS price_k, year(o_orderdate) AS made FROM orders""")
def base_record(spark, d):
    return select.project(t(spark, d, "orders"), {"record_id": "o_orderkey", "owner": "o_custkey", "record_type": F.lit("order"), "price_k": F.round(F.col("o_totalprice") / 1000, 3), "made": F.year("o_orderdate").cast("long")})


@register("""SELECT s_suppkey, n_name AS name, s_acctbal AS balance, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def struct_merge(spark, d):
    j = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a, b = F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return j.select("s_suppkey", select.merge_structs(a, b, ["name", "balance"], ["name", "region"]).alias("m")).select("s_suppkey", "m.*")


@register("SELECT * EXCLUDE (l_discount, l_tax, l_shipdate) FROM lineitem")
def drop_columns(spark, d):
    return t(spark, d, "lineitem").drop("l_discount", "l_tax", "l_shipdate")


@register("""SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY l_orderkey""")
def allowed_fields(spark, d):
    """Nested rows keep only the allowed fields; counted and summed again from what is left."""
    nested = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_tax", "l_linenumber")).alias("items"))
    kept = nested.select("l_orderkey", select.keep_fields(F.col("items"), ["l_partkey"]).alias("items"))
    return kept.select("l_orderkey", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["l_partkey"]).alias("parts"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'success_cached' WHEN 'error' THEN 'error' END"


def _status():
    e = F.col("event_type")
    return F.when(e == "purchase", "success").when(e == "click", "success_cached").when(e == "error", "error")


@register(f"SELECT event_id, {_STATUS} AS status FROM events WHERE starts_with(coalesce({_STATUS}, ''), 'success')")
def status_prefix(spark, d):
    return t(spark, d, "events").select("event_id", _status().alias("status")).where(select.succeeded(F.col("status")))


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def status_in(spark, d):
    return select.by_ids(t(spark, d, "orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderstatus")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 250 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey <= 20")
def range_selector(spark, d):
    o = t(spark, d, "orders")
    return select.in_range(o, "o_orderkey", 100, 250).select("o_orderkey").union(select.in_range(o, "o_orderkey", None, 20).select(-F.col("o_orderkey")))


@register("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 17, 150)")
def id_selector(spark, d):
    return select.by_ids(t(spark, d, "documents"), "doc_id", [1, 5, 17, 150]).select("doc_id", "lang")


@register("""WITH p AS (SELECT p_partkey, 'img\\' || p_brand || '/' || p_type || '.png' AS path FROM part), q AS (SELECT *, replace(path, '\\', '/') AS clean FROM p)
SELECT p_partkey, path FROM q WHERE clean = 'img/Brand#2/ECONOMY.png' OR split_part(clean, '/', -1) = 'PROMO.png'""".replace("\\\\", "\\"))
def path_selector(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("img\\"), "p_brand", F.lit("/"), "p_type", F.lit(".png")).alias("path"))
    return select.by_paths(p, "path", ["img/Brand#2\\ECONOMY.png", "PROMO.png"])


@register("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) AND p_brand = 'Brand#2' AND p_size > 10")
def multi_search(spark, d):
    return select.search(t(spark, d, "part"), " RING ", ["p_name", "p_brand", "p_type"], {"p_brand": "Brand#2"}, F.col("p_size") > 10).select("p_partkey")


@register("SELECT doc_id FROM documents WHERE NOT (contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'idiot'))")
def keyword_reject(spark, d):
    return t(spark, d, "documents").where(~select.mentions(F.col("text"), ["license", "idiot"])).select("doc_id")


@register("""SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'household' THEN 'home' WHEN regexp_matches(lower(c_mktsegment), 'build|machin') THEN 'works' ELSE 'person' END AS kind FROM customer""")
def regex_classify(spark, d):
    kind = select.classify(F.col("c_mktsegment"), {"household": "home"}, [("build|machin", "works"), ("furn", "other")], "person", ("furniture",))
    return t(spark, d, "customer").select("c_custkey", kind.alias("kind"))


@register("SELECT event_id FROM events WHERE trim(coalesce(props, '')) <> '' AND trim(coalesce(CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END, '')) = ''")
def pending_prompts(spark, d):
    """Rows with a prompt and no file."""
    made = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    return t(spark, d, "events").where(select.filled(F.col("props")) & ~select.filled(made)).select("event_id")


@register("SELECT doc_id, try_cast(left(source, 4) AS DOUBLE) IS NOT NULL AS number, try_cast(substr(source, 4) AS DOUBLE) IS NOT NULL AS tail FROM documents")
def type_guard(spark, d):
    return t(spark, d, "documents").select("doc_id", select.is_number(F.left("source", F.lit(4))).alias("number"), select.is_number(F.substr("source", F.lit(4))).alias("tail"))


@register(r"""SELECT p_partkey, (p_size > 10)::INT + (p_brand = 'Brand#2')::INT + (p_type <> 'PROMO')::INT < 2 OR len(string_split(p_name, ' ')) < 2 AS needs FROM part""")
def needs_enrichment(spark, d):
    traits = [F.col("p_size") > 10, F.col("p_brand") == "Brand#2", F.col("p_type") != "PROMO"]
    return t(spark, d, "part").select("p_partkey", select.needs_more(traits, T.word_count(F.col("p_name")), 2, 2).alias("needs"))


@register("""SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'person' WHEN p_type = 'PROMO' THEN 'creature' ELSE 'object' END AS branch FROM part""")
def entity_branch(spark, d):
    return t(spark, d, "part").select("p_partkey", select.classify(F.col("p_type"), {"economy": "person", "standard": "person", "promo": "creature"}, [], "object").alias("branch"))


@register("""WITH s AS (SELECT event_id AS span_id, epoch(ts) AS s, epoch(ts) + value * 100 AS e FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, epoch(ts) AS pt FROM events WHERE event_type = 'purchase')
SELECT p.event_id, span_id FROM p JOIN s ON s.s <= pt AND pt <= s.e QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY s.s, span_id) = 1""")
def point_lookup(spark, d):
    """The first span that holds each point, both ends included."""
    ev = t(spark, d, "events")
    spans = ev.where("event_type = 'view'").select(F.col("event_id").alias("span_id"), epoch("ts").alias("s"), (epoch("ts") + F.col("value") * 100).alias("e"))
    points = ev.where("event_type = 'purchase'").select("event_id", epoch("ts").alias("at"))
    return select.at_point(points, spans, "at", "s", "e", ["s", "span_id"], 3600.0).select("event_id", "span_id")


@register("""SELECT CASE WHEN l_quantity > 30 THEN 'long' WHEN l_quantity < 2 THEN 'brief' WHEN l_quantity BETWEEN 5 AND 10 THEN 'usual' END AS kind, count(*) AS n FROM lineitem GROUP BY 1""")
def duration_filters(spark, d):
    return t(spark, d, "lineitem").groupBy(select.duration_class(F.col("l_quantity")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# joins


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def required_join(spark, d):
    parents = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lookup.require(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parents, "l_orderkey")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_parents(spark, d):
    return lookup.missing(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")


@register("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_with_default(spark, d):
    return lookup.with_default(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@register("SELECT p.page_id, coalesce(left(text, 20), 'no description') AS shown FROM pages p LEFT JOIN documents ON doc_id = p.page_id + 900")
def join_with_text(spark, d):
    texts = t(spark, d, "documents").select((F.col("doc_id") - 900).alias("page_id"), F.left("text", F.lit(20)).alias("shown"))
    return lookup.with_default(t(spark, d, "pages").select("page_id"), texts, "page_id", {"shown": "no description"})


@register("""WITH l AS (SELECT n_regionkey AS scope, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS key, min(n_nationkey) AS id FROM nation GROUP BY ALL),
r AS (SELECT r_regionkey AS scope, unnest(['NATION-0', 'nation 6', 'Nation_12!', 'none']) AS ref FROM region)
SELECT x.scope, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (id IS NOT NULL)), ','), '') AS ids FROM r x LEFT JOIN l ON x.scope = l.scope AND l.key = trim(regexp_replace(lower(ref), '[^a-z0-9]+', ' ', 'g')) GROUP BY x.scope""")
def label_resolution(spark, d):
    """Labels resolve within their own scope only."""
    rows = t(spark, d, "region").select(F.col("r_regionkey").alias("scope"), F.array(*map(F.lit, ["NATION-0", "nation 6", "Nation_12!", "none"])).alias("refs"))
    labels = t(spark, d, "nation").select(F.col("n_regionkey").alias("scope"), "n_name", F.col("n_nationkey").alias("ids"))
    return lookup.label_refs(rows, labels, "scope", "refs", "n_name", "ids").select("scope", F.array_join("ids", ",").alias("ids"))


@register("""SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) = 'nation ' || (s_suppkey % 7))""")
def scoped_reference(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("scope"), F.concat(F.lit("Nation-"), F.col("s_suppkey") % 7).alias("ref"))
    return lookup.linked(rows, t(spark, d, "nation").withColumn("scope", F.col("n_nationkey")), "scope", "ref", "n_name").select("s_suppkey")


@register("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey AND x.l_linenumber = lineitem.l_linenumber AND x.l_returnflag = 'R')".replace("WHERE NOT EXISTS", "lineitem WHERE NOT EXISTS"))
def pending_composite(spark, d):
    from ..operators import records

    li = t(spark, d, "lineitem")
    return records.pending(li.select("l_orderkey", "l_linenumber").distinct(), li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"])


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_acctbal > 0")
def evidence_semi(spark, d):
    """Rows of confirmed keys that have facts."""
    confirmed = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").where("c_acctbal > 0").join(confirmed, "c_custkey", "left_semi").select("c_custkey")


@register("""SELECT doc_id FROM documents WHERE len(list_filter([split_part(text, ' ', 3), 'Moron', ' '], lambda n: trim(n) <> '' AND contains(lower(text), lower(trim(n))))) > 0""")
def relevant_names(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.array(F.split_part("text", F.lit(" "), F.lit(3)), F.lit("Moron"), F.lit(" ")).alias("names"), F.col("text").alias("evidence"))
    return lookup.relevant(docs, "names", "evidence").select("doc_id")


@register("""WITH k AS (SELECT lower(n_name) AS key, min(n_nationkey) AS ord FROM nation GROUP BY 1),
r AS (SELECT c_custkey, 'nation_' || (c_custkey % 400) AS a, 'nation_' || (c_custkey % 90) AS b FROM customer)
SELECT c_custkey, CASE WHEN ka.key IS NOT NULL THEN ka.key WHEN kb.key IS NOT NULL THEN kb.key ELSE (SELECT min_by(key, {'o': ord, 'k': key}) FROM k WHERE length(key) >= 4 AND length(a) >= 4 AND (contains(a, key) OR contains(key, a))) END AS key,
CASE WHEN ka.key IS NOT NULL THEN 'first' WHEN kb.key IS NOT NULL THEN 'second' WHEN EXISTS (SELECT 1 FROM k WHERE length(key) >= 4 AND length(a) >= 4 AND (contains(a, key) OR contains(key, a))) THEN 'contained' END AS how
FROM r LEFT JOIN k ka ON ka.key = a LEFT JOIN k kb ON kb.key = b""")
def fuzzy_names(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation_"), F.col("c_custkey") % 400).alias("a"), F.concat(F.lit("nation_"), F.col("c_custkey") % 90).alias("b"))
    table = t(spark, d, "nation").select(F.lower("n_name").alias("key"), F.col("n_nationkey").alias("ord"))
    return lookup.fuzzy_cascade(rows, table, "a", "b", "key", "ord").select("c_custkey", "key", "how")


@register("""WITH k AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_size AS rich FROM part),
r AS (SELECT s_suppkey, [s_suppkey * 50, s_suppkey % 40] AS ids, 'Small  Ring' AS name FROM supplier),
i AS (SELECT s_suppkey, arg_min({'id': k.id, 'key': key, 'rich': rich}, pos) AS i FROM (SELECT s_suppkey, unnest(ids) AS x, generate_subscripts(ids, 1) AS pos FROM r) JOIN k ON k.id = x GROUP BY s_suppkey),
b AS (SELECT key, id, rich FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY rich DESC, id) = 1)
SELECT r.s_suppkey, CASE WHEN i.i IS NULL OR b.rich > i.i.rich THEN b.id ELSE i.i.id END AS p_partkey FROM r LEFT JOIN i USING (s_suppkey) LEFT JOIN b ON b.key = coalesce(i.i.key, 'small ring')""")
def resolve_records(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_suppkey") * 50, F.col("s_suppkey") % 40).alias("ids"), F.lit("Small  Ring").alias("name"))
    return lookup.best_record(rows, t(spark, d, "part"), "ids", "name", "p_partkey", "p_name", "p_size").select("s_suppkey", "p_partkey")


@register("""SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN c_mktsegment END AS note FROM customer""")
def preferred_source(spark, d):
    c = t(spark, d, "customer")
    rich = c.select("c_custkey", F.when(F.col("c_acctbal") > 5000, "rich").otherwise(" ").alias("note"))
    return lookup.prefer(c.select("c_custkey"), rich, c.where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("note")), "c_custkey", "note", F.trim("note") != "")


@register("""SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'Guest ' || conv_id ELSE role END AS name FROM conversations""")
def speaker_names(spark, d):
    c = t(spark, d, "conversations")
    guesses = c.where("role = 'user'").select("conv_id", "role", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Guest "), "conv_id")).otherwise(" ").alias("name"))
    return lookup.speakers(c.select("conv_id", "turn", "role"), guesses, "conv_id", "role", "name").select("conv_id", "turn", "name")


@register("""SELECT l_orderkey, i AS place, (list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey))[i + 1] AS part, (list(l_suppkey ORDER BY l_suppkey, l_linenumber, l_partkey) FILTER (l_linenumber <> 2))[i + 1] AS supplier
FROM lineitem, range(0, 20) r(i) GROUP BY l_orderkey, i HAVING i < count(*) FILTER (l_linenumber <> 2)""")
def positional_zip(spark, d):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l_partkey"]).alias("a"), F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") != 2, F.struct("l_suppkey", "l_linenumber", "l_partkey")))), lambda x: x["l_suppkey"]).alias("b"))
    z = g.select("l_orderkey", F.posexplode(lookup.zip_arrays(F.col("a"), F.col("b"), ("part", "supplier"))).alias("place", "z"))
    return z.select("l_orderkey", F.col("place").cast("long").alias("place"), "z.part", "z.supplier")
