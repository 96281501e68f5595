"""The registered queries of the engine's own operators, with their SQL oracles."""

from __future__ import annotations

import operator
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import guarded_ratio
from .functions.time import PATTERN, hours_between, parse_time, weekday
from .operators import aggregates, joins, sorting, transforms, udf
from .plans import roads, texts, voronoi
from .plans.pipeline import Pipeline
from .sources import io
from .sources.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PUNCTUATION = string.punctuation.replace("'", "''")


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_WS}'), lambda x: x <> '')"


_WORDS = _tokens(f"lower(translate(text, '{_PUNCTUATION}', ''))")


def _query(oracle: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return io.parquet(spark, f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


# rows


@_query("select * from region")
def identity_region(spark, d):
    return _table(spark, d, "region").transform(transforms.identity())


@_query(f"select page_id, translate(url, '{_PUNCTUATION}', '') as url from pages")
def strip_punctuation_urls(spark, d):
    return _table(spark, d, "pages").select("page_id", "url").transform(transforms.strip_punctuation("url"))


@_query("select conv_id, turn, role, lower(text) as text from conversations")
def lower_conversations(spark, d):
    return _table(spark, d, "conversations").transform(transforms.lower_case("text"))


@_query(f"select conv_id, turn, unnest({_tokens('text')}) as text from conversations")
def split_words(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", "text").transform(transforms.split("text"))


@_query("select o_orderkey, unnest(string_split(o_orderpriority, '-')) as o_orderpriority from orders")
def split_literal_priority(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", "o_orderpriority").transform(transforms.split("o_orderpriority", "-"))


@_query("select p_partkey, unnest(string_split(p_brand, '')) as p_brand from part")
def split_characters_brand(spark, d):
    return _table(spark, d, "part").select("p_partkey", "p_brand").transform(transforms.split("p_brand", ""))


@_query("select o_orderkey, unnest(case when o_orderpriority = '5-LOW' then [null] else string_split(o_orderpriority, '-') end) as part from orders")
def split_null_passes(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("part")).transform(transforms.split("part", "-"))


@_query("select o_orderkey, o_totalprice from orders")
def split_of_number_passes(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", "o_totalprice").transform(transforms.split("o_totalprice"))


@_query("select l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_extendedprice * l_quantity as revenue from lineitem")
def product_revenue(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").transform(transforms.product(["l_extendedprice", "l_quantity"], "revenue"))


@_query("select r_regionkey, 1::bigint as product from region")
def product_of_nothing(spark, d):
    return _table(spark, d, "region").select("r_regionkey").transform(transforms.product([]))


@_query("select * from lineitem where l_returnflag = 'R' and l_discount > 0.05")
def filter_returns(spark, d):
    return _table(spark, d, "lineitem").transform(transforms.keep((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)))


@_query("select * from orders where (o_custkey % 3) <> 0")
def filter_truthy_number(spark, d):
    return _table(spark, d, "orders").transform(transforms.keep("o_custkey % 3"))


@_query("select o_totalprice, o_orderkey from orders")
def project_orders(spark, d):
    return _table(spark, d, "orders").transform(transforms.project(["o_totalprice", "o_orderkey"]))


@_query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge from lineitem")
def compute_charge(spark, d):
    new = transforms.compute("charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return _table(spark, d, "lineitem").transform(new).select("l_orderkey", "l_linenumber", "charge")


@_query("select p_partkey, upper(p_name) as p_name from part")
def compute_overwrites(spark, d):
    return _table(spark, d, "part").select("p_partkey", "p_name").transform(transforms.compute("p_name", "upper(p_name)"))


# groups


@_query("select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def first_order_per_customer(spark, d):
    return _table(spark, d, "orders").transform(aggregates.first_by(["o_custkey"], ["o_orderdate", "o_orderkey"]))


@_query("select * from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def top3_orders_per_customer(spark, d):
    return _table(spark, d, "orders").transform(aggregates.top_n(["o_custkey"], "o_totalprice", 3, ["o_orderkey"]))


@_query("select * from orders order by o_totalprice desc, o_orderkey limit 10")
def top10_orders(spark, d):
    return _table(spark, d, "orders").transform(aggregates.top_n([], "o_totalprice", 10, ["o_orderkey"]))


@_query("select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) as tf from events group by user_id, event_type")
def term_frequency_events(spark, d):
    return _table(spark, d, "events").transform(aggregates.term_frequency(["user_id"], "event_type"))


@_query("select event_type, count(*) / sum(count(*)) over () as tf from events group by event_type")
def term_frequency_no_keys(spark, d):
    return _table(spark, d, "events").transform(aggregates.term_frequency([], "event_type"))


@_query("""
with f as (select user_id, ts, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)
select e.user_id, event_type, count(*) / sum(count(*)) over (partition by e.user_id) as tf, f.event_id
from events e join f on e.user_id = f.user_id group by e.user_id, event_type, f.event_id""")
def term_frequency_carried(spark, d):
    return _table(spark, d, "events").transform(aggregates.term_frequency(["user_id"], "event_type", carry=["event_id"], order_by=["ts", "event_id"]))


@_query("select c_mktsegment, count(*) as n from customer group by c_mktsegment")
def count_by_segment(spark, d):
    return _table(spark, d, "customer").transform(aggregates.count_by(["c_mktsegment"], "n"))


@_query("select count(*) as n from customer")
def count_all(spark, d):
    return _table(spark, d, "customer").transform(aggregates.count_by([], "n"))


@_query("select count(*) as n from customer where c_custkey < 0 having count(*) > 0")
def count_of_nothing(spark, d):
    return _table(spark, d, "customer").filter("c_custkey < 0").transform(aggregates.count_by([], "n"))


@_query("select count(*) as c_nationkey from customer group by c_nationkey")
def count_over_key(spark, d):
    return _table(spark, d, "customer").transform(aggregates.count_by(["c_nationkey"], "c_nationkey"))


@_query("select l_suppkey, sum(l_quantity) as l_quantity from lineitem group by l_suppkey")
def sum_quantity_by_supplier(spark, d):
    return _table(spark, d, "lineitem").transform(aggregates.sum_by(["l_suppkey"], "l_quantity"))


@_query("select event_type, avg(try_cast(props ->> '$.k' as double)) as k from events group by event_type having count(try_cast(props ->> '$.k' as double)) > 0")
def average_property(spark, d):
    return _table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).transform(aggregates.average_by(["event_type"], "k"))


_MIXED = "(values ('a', '1'), ('a', 'x'), ('a', null), ('a', ' 4 '), ('b', 'bad'), ('b', null), ('c', '1e3')) as t(g, v)"


@_query(f"select g, avg(try_cast(v as double)) as mean from {_MIXED} group by g having count(try_cast(v as double)) > 0")
def average_skips_invalid(spark, d):
    return spark.sql(f"select * from {_MIXED}").transform(aggregates.average_by(["g"], "v", "mean"))


@_query(f"select doc_id, count(distinct word) as n from (select doc_id, unnest({_WORDS}) as word from documents) group by doc_id")
def distinct_words_per_document(spark, d):
    docs = io.deal(_documents(spark, d), ["doc_id"]).select("doc_id", F.explode(texts.words(F.col("text"))).alias("word"))
    return docs.dropDuplicates(["doc_id", "word"]).transform(aggregates.count_by(["doc_id"], "n"))


@_query("""
with s as (select event_id, ts, event_type, value, coalesce((lag(event_type) over (order by ts, event_id) is distinct from event_type)::int, 1) as start from events),
r as (select *, sum(start) over (order by ts, event_id rows unbounded preceding) as run from s)
select run::bigint as run, event_type, count(*) as n, round(sum(value), 6) as value from r group by run, event_type""")
def runs_of_event_types(spark, d):
    runs = aggregates.reduce_runs(["event_type"], ["ts", "event_id"], [F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")])
    return _table(spark, d, "events").transform(runs)


# joins and sorting


@_query("select o_custkey as c_custkey, o_orderkey, o_totalprice, c_name from orders join customer on o_custkey = c_custkey")
def inner_orders_customer(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.join(orders, _table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@_query("select s_nationkey as nation, s_suppkey, s_acctbal as acctbal_s, c_custkey, c_acctbal as acctbal_c from supplier join customer on s_nationkey = c_nationkey")
def inner_suffixes(spark, d):
    s = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("acctbal"))
    c = _table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("acctbal"))
    # the few nations' rows are multiplied: as many tasks as keep all cores busy
    return joins.join(s, c, ["nation"], suffixes=("_s", "_c"), deal=4 * spark.sparkContext.defaultParallelism)


@_query("select r_regionkey, r_name, (select count(*) from nation) as n from region")
def cross_region_total(spark, d):
    return joins.join(_table(spark, d, "region"), _table(spark, d, "nation").transform(aggregates.count_by([], "n")), [])


def _valued(spark, d, table, key, value, *others):
    return _table(spark, d, table).select(F.col(key).alias("id"), F.col(value).cast("long").alias("value"), *others)


@_query("select a.doc_id as id, a.n_chars::bigint as value_1, source, b.quality::bigint as value_2, toxic from documents a left join labels b on a.doc_id = b.doc_id")
def left_documents_labels(spark, d):
    return joins.join(_valued(spark, d, "documents", "doc_id", "n_chars", "source"), _valued(spark, d, "labels", "doc_id", "quality", "toxic"), ["id"], "left")


@_query("select b.doc_id as id, a.quality::bigint as value_1, toxic, b.n_chars::bigint as value_2, source from labels a right join documents b on a.doc_id = b.doc_id")
def right_labels_documents(spark, d):
    return joins.join(_valued(spark, d, "labels", "doc_id", "quality", "toxic"), _valued(spark, d, "documents", "doc_id", "n_chars", "source"), ["id"], "right")


@_query("select coalesce(a.doc_id, b.vec_id) as id, toxic, case when b.vec_id is not null then b.label else a.quality end::bigint as value from labels a full join embeddings b on a.doc_id = b.vec_id")
def outer_labels_embeddings(spark, d):
    """Either side has rows that the other lacks."""
    return joins.join(_valued(spark, d, "labels", "doc_id", "quality", "toxic"), _valued(spark, d, "embeddings", "vec_id", "label"), ["id"], "outer")


_LEFT, _RIGHT = "(values (1, 'a'), (null, 'b'), (3, 'c')) as t(k, x)", "(values (1, 'd'), (null, 'e'), (4, 'f')) as t(k, y)"


@_query(f"select coalesce(a.k, b.k) as k, x, y from (select * from {_LEFT}) a full join (select * from {_RIGHT}) b on a.k is not distinct from b.k")
def join_null_keys(spark, d):
    return joins.join(spark.sql(f"select * from {_LEFT}"), spark.sql(f"select * from {_RIGHT}"), ["k"], "outer")


@_query("select * from part order by p_size, p_partkey")
def sort_parts(spark, d):
    return _table(spark, d, "part").transform(sorting.sort(["p_size", "p_partkey"]))


# pipelines


@_query(f"select word as text, count(*) as count from (select unnest({_WORDS}) as word from documents) group by word")
def word_count(spark, d):
    return texts.word_count(_documents(spark, d))


@_query(f"""
with w as (select doc_id, unnest({_WORDS}) as word from documents),
c as (select doc_id, word, count(*) as n from w group by doc_id, word),
t as (select doc_id, sum(n) as total from c group by doc_id),
f as (select word, count(*) as df from c group by word),
s as (select c.doc_id, c.word, round(n / total * ln((select count(*) from documents) / df), 9) as tf_idf from c join t using (doc_id) join f using (word))
select doc_id, word as text, tf_idf from s qualify row_number() over (partition by word order by tf_idf desc, doc_id) <= 3""")
def tf_idf_top3(spark, d):
    return texts.inverted_index(_documents(spark, d))


@_query(f"""
with w as (select doc_id, unnest({_WORDS}) as word from documents),
c as (select doc_id, word, count(*) as n from w where length(word) > 4 group by doc_id, word having count(*) >= 2),
t as (select doc_id, sum(n) as total from c group by doc_id),
f as (select word, sum(n) as all_docs from c group by word),
s as (select c.doc_id, c.word, round(ln((n / total) / (all_docs / (select sum(n) from c))), 9) as pmi from c join t using (doc_id) join f using (word))
select doc_id, word as text, pmi from s qualify row_number() over (partition by doc_id order by pmi desc, word) <= 10""")
def pmi_top10(spark, d):
    return texts.pmi(_documents(spark, d))


@_query(f"""
with w as (select doc_id, unnest({_WORDS}) as word from documents), n as (select count(*) as docs from documents)
select word, count(distinct doc_id) as df, n.docs from w cross join n group by word, n.docs having count(distinct doc_id) > 5""")
def pipeline_document_frequency(spark, d):
    """A pipeline of two branches over one source, joined again."""
    docs = Pipeline.source("docs")
    words = docs.then(transforms.project(["doc_id", "text"]), transforms.strip_punctuation("text"), transforms.lower_case("text"), transforms.split("text"))
    df = words.then(lambda x: x.dropDuplicates(["doc_id", "text"]), aggregates.count_by(["text"], "df"), transforms.keep("df > 5"))
    both = df.join(docs.then(aggregates.count_by([], "docs")), [])
    return both.run(docs=io.deal(_documents(spark, d), ["doc_id"])).withColumnRenamed("text", "word")


_ROADS = """
select event_id, user_id, ts, value, embedding[1]::double as e0, embedding[2]::double as e1, embedding[3]::double as e2, embedding[4]::double as e3
from events join embeddings on user_id = vec_id where value > 0"""


@_query(f"""
with t as ({_ROADS}),
k as (select ts, value, 37 + e0 as lon1, 55 + e1 as lat1, 37 + e2 as lon2, 55 + e3 as lat2 from t),
h as (select ts, round(value * 1e6) / 3.6e9 as hours, 2 * 6371.0 * asin(sqrt(least(pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
      + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2), 1.0))) as km from k)
select strftime(ts, '%a') as weekday, hour(ts)::int as hour, round(avg(km / hours), 6) as speed from h where km > 0 and hours > 0 group by all""")
def road_speed_events(spark, d):
    trips = _table(spark, d, "events").filter("value > 0").select(F.col("user_id").alias("edge_id"), F.col("ts").cast("timestamp").alias("enter_time"), "value")
    trips = trips.withColumn("leave_time", F.timestamp_micros(F.unix_micros("enter_time") + F.round(F.col("value") * 1e6).cast("long")))
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    edges = _table(spark, d, "embeddings").select(F.col("vec_id").alias("edge_id"), F.array(37 + e[0], 55 + e[1]).alias("start"), F.array(37 + e[2], 55 + e[3]).alias("end"))
    return roads.road_speed(trips, edges).withColumn("speed", F.round("speed", 6))


_TRIPS = "(values (1, '20240105T101500.0', '20240105T102500.000000'), (1, '20240105T103000.123', '20240105T105000.123'), (2, '20240106T000000.5', '20240106T003000.5'), (2, 'bad', '20240106T003000.5'), (3, '20240107T100000.0', '20240107T090000.0'), (3, '20240107T100000.0', '20240107T110000.0'), (9, '20240107T100000.0', '20240107T110000.0')) as t(edge_id, enter_time, leave_time)"
_EDGES = "(values (1, '1500'), (2, '80'), (3, '2500.5')) as t(edge_id, length)"


@_query(f"""
with t as (select edge_id, try_strptime(enter_time, '%Y%m%dT%H%M%S.%f') as enter, try_strptime(leave_time, '%Y%m%dT%H%M%S.%f') as leave from {_TRIPS}),
e as (select edge_id, case when length::double > 100 then length::double / 1000 else length::double end as km from {_EDGES})
select strftime(enter, '%a') as weekday, hour(enter)::int as hour, round(avg(km / ((epoch_us(leave) - epoch_us(enter)) / 3.6e9)), 9) as speed
from t join e using (edge_id) where leave > enter group by all""")
def road_speed_given_length(spark, d):
    edges = spark.sql(f"select *, array(0D, 0D) as start, array(0D, 0D) as end from {_EDGES}")
    return roads.road_speed(spark.sql(f"select * from {_TRIPS}"), edges).withColumn("speed", F.round("speed", 9))


@_query("select event_id, ts, strftime(ts, '%a') as weekday, hour(ts)::int as hour from events")
def time_round_trip(spark, d):
    text = _table(spark, d, "events").select("event_id", F.date_format("ts", PATTERN).alias("t"))
    parsed = text.select("event_id", parse_time(F.col("t")).alias("time"))
    return parsed.select("event_id", F.col("time").cast("timestamp_ntz").alias("ts"), weekday(F.col("time")).alias("weekday"), F.hour("time").alias("hour"))


@_query("select event_id, (case when value > 0 then round(value * 1e6) / 3.6e9 else 0.0 end)::double as hours, (case when user_id % 5 <> 0 then value / (user_id % 5) else 0.0 end)::double as ratio from events")
def durations_and_ratios(spark, d):
    e = _table(spark, d, "events").withColumn("a", F.col("ts").cast("timestamp"))
    leave = F.timestamp_micros(F.unix_micros("a") + F.round(F.col("value") * 1e6).cast("long"))
    return e.select("event_id", hours_between(F.col("a"), leave).alias("hours"), guarded_ratio(F.col("value"), F.col("user_id") % 5).alias("ratio"))


def _points(spark, d):
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (50 + 100 * F.get("embedding", F.lit(0)).cast("double")).alias("x"), (30 + 60 * F.get("embedding", F.lit(1)).cast("double")).alias("y")).filter("x between 0 and 100 and y between 0 and 60")


@_query("select 6000.0::double as area, count(*) as n from embeddings where 50 + 100 * embedding[1]::double between 0 and 100 and 30 + 60 * embedding[2]::double between 0 and 60")
def voronoi_area(spark, d):
    cells = voronoi.cells(_points(spark, d), 100.0, 60.0)
    return cells.select(voronoi.area(F.col("cell")).alias("a")).agg(F.round(F.sum("a"), 6).alias("area"), F.count("*").alias("n"))


# vertices by clipping with the bisectors to all other points, one after the other
_VERTICES = """
with recursive
p as (select vec_id as id, 50 + 100 * embedding[1]::double as x, 30 + 60 * embedding[2]::double as y from embeddings),
q as (select *, row_number() over (order by id) as n from p where x between 0 and 100 and y between 0 and 60),
c as (
  select id, x, y, n, 0::bigint as step, [{'x': 0.0::double, 'y': 0.0::double}, {'x': 100.0::double, 'y': 0.0::double}, {'x': 100.0::double, 'y': 60.0::double}, {'x': 0.0::double, 'y': 60.0::double}] as cell from q
  union all
  select c.id, c.x, c.y, c.n, q.n, case when q.n = c.n then cell else (
    with h as (select list_transform(cell, lambda v: 2 * (q.x - c.x) * v.x + 2 * (q.y - c.y) * v.y + c.x * c.x + c.y * c.y - q.x * q.x - q.y * q.y) as side)
    select flatten(list_transform(range(1, len(cell) + 1), lambda k: list_concat(
      case when (side[k] <= 1e-9) <> (side[case when k = 1 then len(cell) else k - 1 end] <= 1e-9) then [{
        'x': cell[case when k = 1 then len(cell) else k - 1 end].x + side[case when k = 1 then len(cell) else k - 1 end] / (side[case when k = 1 then len(cell) else k - 1 end] - side[k]) * (cell[k].x - cell[case when k = 1 then len(cell) else k - 1 end].x),
        'y': cell[case when k = 1 then len(cell) else k - 1 end].y + side[case when k = 1 then len(cell) else k - 1 end] / (side[case when k = 1 then len(cell) else k - 1 end] - side[k]) * (cell[k].y - cell[case when k = 1 then len(cell) else k - 1 end].y)}] else [] end,
      case when side[k] <= 1e-9 then [cell[k]] else [] end))) from h) end
  from c join q on q.n = c.step + 1),
v as (select id, unnest(cell) as v, generate_subscripts(cell, 1) as k, len(cell) as size from c where step = (select count(*) from q)),
s as (select *, first_value(k) over (partition by id order by round(v.y, 8), v.x) as start from v)
select id, ((k - start + size) % size)::int as k, round(v.x, 6) + 0.0::double as x, round(v.y, 6) + 0.0::double as y from s"""


@_query(_VERTICES)
def voronoi_vertices(spark, d):
    cells = voronoi.cells(_points(spark, d), 100.0, 60.0)
    return cells.select("id", F.posexplode("cell").alias("k", "v")).select("id", "k", *[(F.round(f"v.{c}", 6) + F.lit(0.0)).alias(c) for c in "xy"])


def _corners(numbers):
    """Corners in the numbers of a cell's line: how many there are, and x and y of each."""
    corner = lambda k: F.struct(F.get(numbers, 2 * k + 1).alias("x"), F.get(numbers, 2 * k + 2).alias("y"))
    return F.transform(F.sequence(F.lit(0), (F.get(numbers, F.lit(0)) - 1).cast("int")), corner)


@_query(_VERTICES.replace("round(v.x, 6)", "round(round(v.x, 8), 6)").replace("round(v.y, 6)", "round(round(v.y, 8), 6)"))
def voronoi_cells(spark, d):
    """Cells as lines of text with eight decimals, read again."""
    lines = io.format_cells(voronoi.cells(_points(spark, d), 100.0, 60.0))
    cells = lines.select("id", _corners(F.transform(F.split("line", " "), lambda x: x.cast("double"))).alias("cell"))
    return cells.select("id", F.posexplode("cell").alias("k", "v")).select("id", "k", *[(F.round(f"v.{c}", 6) + F.lit(0.0)).alias(c) for c in "xy"])


# files and command lines, through the shared folder


@_query("select conv_id, turn, nullif(role, 'user') as role, text from conversations")
def json_lines_out_and_in(spark, d):
    """Missing values are left out of the lines and are null again."""
    path = shared_path(spark, "catalog-json")
    io.write_json_lines(_table(spark, d, "conversations").withColumn("role", F.nullif("role", F.lit("user"))), path)
    return io.json_lines(spark, path, "conv_id long, turn long, role string, text string")


def _lines(spark, d):
    path = shared_path(spark, "catalog-text")
    _table(spark, d, "part").select(F.concat_ws(";", "p_partkey", "p_size", "p_name")).write.text(path)
    return path


@_query("select p_partkey, p_size, p_name from part")
def text_lines_columns(spark, d):
    fields = F.split("value", ";", 3)
    return io.text_lines(spark, _lines(spark, d), columns={"p_partkey": fields[0].cast("long"), "p_size": fields[1].cast("int"), "p_name": fields[2]})


@_query("select p_partkey, p_size, p_name from part")
def text_lines_parser(spark, d):
    def parse(line):
        key, size, name = line.split(";", 2)
        return {"p_partkey": int(key), "p_size": int(size), "p_name": name}

    return io.text_lines(spark, _lines(spark, d), parse, "p_partkey long, p_size int, p_name string")


def _field(spark, d):
    """A text of width, height, number of points and the points by id, in one file."""
    path = shared_path(spark, "catalog-field")
    points = _points(spark, d).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("p"))
    numbers = F.transform("p", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    points.select(F.array_join(F.concat(F.array(F.lit("100 60"), F.size("p").cast("string")), numbers), "\n")).write.text(path)
    return path


@_query("""
with p as (select vec_id, 50 + 100 * embedding[1]::double as x, 30 + 60 * embedding[2]::double as y from embeddings)
select 100.0::double as width, 60.0::double as height, (row_number() over (order by vec_id) - 1)::int as id, x, y from p where x between 0 and 100 and y between 0 and 60""")
def field_and_points_scan(spark, d):
    width, height, points = io.field_and_points(spark, _field(spark, d))
    return points.select(F.lit(width).alias("width"), F.lit(height).alias("height"), "id", "x", "y")


def _command(spark, schema, command, **tables):
    """Rows that a command line writes from tables put into JSON lines."""
    from . import cli

    arguments = [command]
    for option, df in tables.items():
        path = shared_path(spark, f"catalog-{option}")
        io.write_json_lines(df, path)
        arguments += ["--" + option.replace("_", "-"), path]
    out = shared_path(spark, f"catalog-{command}")
    cli.main([*arguments, "--output", out], spark)
    return io.json_lines(spark, out, schema)


def _plain_documents(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")


@_query(ORACLES["word_count"])
def command_word_count(spark, d):
    return _command(spark, "text string, count long", "word-count", input=_plain_documents(spark, d))


@_query("with documents as (select doc_id::varchar as doc_id, text from documents) select * from (" + ORACLES["tf_idf_top3"] + ")")
def command_inverted_index(spark, d):
    return _command(spark, "doc_id string, text string, tf_idf double", "inverted-index", input=_plain_documents(spark, d))


@_query("with documents as (select doc_id::varchar as doc_id, text from documents) select * from (" + ORACLES["pmi_top10"] + ")")
def command_pmi(spark, d):
    return _command(spark, "doc_id string, text string, pmi double", "pmi", input=_plain_documents(spark, d))


@_query(ORACLES["road_speed_given_length"])
def command_road_speed(spark, d):
    edges = spark.sql(f"select *, array(0D, 0D) as start, array(0D, 0D) as end from {_EDGES}")
    out = _command(spark, "weekday string, hour int, speed double", "road-speed", travel_times=spark.sql(f"select * from {_TRIPS}"), edges=edges)
    return out.withColumn("speed", F.round("speed", 9))


@_query("select count(*) as n, 6000.0::double as area from embeddings where 50 + 100 * embedding[1]::double between 0 and 100 and 30 + 60 * embedding[2]::double between 0 and 60")
def command_voronoi(spark, d):
    """Number of cells in the command's lines, and the area that their corners enclose."""
    from . import cli

    out = shared_path(spark, "catalog-voronoi")
    cli.main(["voronoi", "--input", _field(spark, d), "--output", out], spark)
    numbers = io.text_lines(spark, out, columns={"v": F.transform(F.split("value", " "), lambda x: x.cast("double"))})
    cells = numbers.select(_corners(F.col("v")).alias("cell"))
    return cells.agg(F.count("*").alias("n"), F.round(F.sum(voronoi.area(F.col("cell"))), 4).alias("area"))


# arbitrary Python


@_query(f"select item_id, unnest({_tokens('text')}) as word from benchmark")
def udf_map_rows(spark, d):
    return _table(spark, d, "benchmark").transform(udf.map_rows(lambda r: ({"item_id": r["item_id"], "word": w} for w in r["text"].split()), "item_id long, word string"))


@_query("select c_nationkey, max(c_acctbal) - min(c_acctbal) as spread from customer group by c_nationkey")
def udf_reduce_groups(spark, d):
    def spread(keys, rows):
        rows = list(rows)
        values = [r["c_acctbal"] for r in rows]
        yield {"c_nationkey": rows[0]["c_nationkey"], "spread": max(values) - min(values)}

    return _table(spark, d, "customer").select("c_nationkey", "c_acctbal").transform(udf.reduce_groups(spread, ["c_nationkey"], "c_nationkey int, spread double"))


@_query("select n_nationkey as nation, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers, (select count(*) from customer where c_nationkey = n_nationkey) as customers from nation where exists (select * from supplier where s_nationkey = n_nationkey) or exists (select * from customer where c_nationkey = n_nationkey)")
def udf_join_groups(spark, d):
    def sizes(keys, a, b):
        a, b = list(a), list(b)
        yield {"nation": (a or b)[0]["nation"], "suppliers": len(a), "customers": len(b)}

    s, c = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), _table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return udf.join_groups(s, c, sizes, ["nation"], "nation int, suppliers long, customers long")


@_query("select p_partkey, p_size * 2 + 1 as odd from part where p_size % 2 = 1")
def udf_filter_and_compute(spark, d):
    part = _table(spark, d, "part").select("p_partkey", "p_size").transform(transforms.keep(lambda r: r["p_size"] % 2))
    return part.transform(transforms.compute("odd", lambda r: operator.add(2 * r["p_size"], 1), "int")).select("p_partkey", "odd")
