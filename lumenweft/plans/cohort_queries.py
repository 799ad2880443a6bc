"""Cohort queries: filters, joins, aggregates, statistics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweft.functions.distributions import t_two_sided_p
from lumenweft.operators import cohort
from lumenweft.plans.catalog import query
from lumenweft.sources.tables import status, table, unfinished

R6 = lambda c: F.round(c, 6)
TYPES = ["click", "view", "purchase", "signup", "logout"]


@query("select c_custkey, c_name from customer")
def scan_project(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def filter_isin(spark, d):
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def filter_eq(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("select page_id, url from pages where contains(url, '1') and not contains(url, '2')")
def filter_contains(spark, d):
    return table(spark, d, "pages").filter(F.col("url").contains("1") & ~F.col("url").contains("2")).select("page_id", "url")


@query("select doc_id, source from documents where ends_with(source, '1')")
def filter_suffix(spark, d):
    return table(spark, d, "documents").filter(F.col("source").endswith("1")).select("doc_id", "source")


@query("select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id) where quality is not null and toxic is not null")
def dropna_any(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").na.drop("any")


@query("select p_brand as feature, p_partkey, case when p_size > 49 then p_size else 0 end as v from part where p_brand in (select p_brand from part where p_size > 49)")
def drop_zero_features(spark, d):
    long = table(spark, d, "part").select(F.col("p_brand").alias("feature"), "p_partkey", F.when(F.col("p_size") > 49, F.col("p_size")).otherwise(0).alias("v"))
    return long.join(long.groupBy("feature").agg(F.bool_or(F.col("v") != 0).alias("some")).filter("some").select("feature"), "feature", "left_semi")


@query("select event_type, count(distinct user_id) as n from events group by 1 having count(distinct user_id) >= 10")
def channel_k_of_n(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n")).filter("n >= 10")


@query("select user_id, count(*) as n from events group by 1 having count(*) >= 60")
def min_length_guard(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 60")


@query("select n_name, cast(row_number() over (order by n_name) - 1 as int) as num_index from nation")
def with_row_index(spark, d):
    return table(spark, d, "nation").select("n_name", (F.row_number().over(Window.orderBy("n_name")) - 1).alias("num_index"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_anti(spark, d):
    return unfinished(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("select l_returnflag as flag, 'n' as stat, count(*)::double as v from lineitem group by 1 union all select l_returnflag, 'mean', round(avg(l_quantity), 6) from lineitem group by 1")
def unpivot_stats(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").cast("double").alias("n"), R6(F.avg("l_quantity")).alias("mean"))
    return wide.unpivot("flag", ["n", "mean"], "stat", "v")


@query("select l_orderkey, l_linenumber, case when l_discount <= 0.05 then l_discount end as shown from lineitem")
def mask_threshold(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") <= 0.05, F.col("l_discount")).alias("shown"))


@query("select doc_id, source, quality from documents join labels using (doc_id)")
def join_inner(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", "quality")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_catalog(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select doc_id, n_name from documents join nation on cast(substr(source, 4) as int) = n_nationkey")
def join_derived_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr("try_cast(substr(source, 4) as int)").alias("k"))
    return docs.join(table(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).select("doc_id", "n_name")


@query("select user_id, " + ", ".join(f"max(case when event_type = '{t}' then value end) as \"{t}\"" for t in TYPES) + f" from events where event_type in ({', '.join(repr(t) for t in TYPES)}) group by 1")
def pivot_eav(spark, d):
    return cohort.pivot_fields(table(spark, d, "events"), "user_id", "event_type", "value", TYPES)


@query("select coalesce(a.k, b.k) as k, a.n as n_customers, b.n as n_suppliers from (select c_nationkey k, count(*) n from customer where c_acctbal > 9000 group by 1) a full join (select s_nationkey k, count(*) n from supplier where s_acctbal > 5000 group by 1) b on a.k = b.k")
def join_full(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def join_semi(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("select n_nationkey, min(s_suppkey) as s_suppkey from nation join supplier on ends_with(s_name, lpad(n_nationkey::varchar, 2, '0')) group by 1")
def join_contains_first(spark, d):
    """Containment of a key in a name, first match: the key is cut out, so it is an equality join."""
    s = table(spark, d, "supplier").select("s_suppkey", F.expr("right(s_name, 2)").alias("k"))
    n = table(spark, d, "nation").select("n_nationkey", F.expr("lpad(cast(n_nationkey as string), 2, '0')").alias("k"))
    return n.join(s, "k").groupBy("n_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("select a.r_name as row, b.r_name as col, a.r_name || '_' || b.r_name as pair from region a, region b")
def join_cross(spark, d):
    r = table(spark, d, "region")
    x = r.select(F.col("r_name").alias("row")).crossJoin(r.select(F.col("r_name").alias("col")))
    return x.withColumn("pair", F.concat_ws("_", "row", "col"))


@query("select a.r_name as first, b.r_name as second from region a join region b on a.r_regionkey < b.r_regionkey")
def pairs(spark, d):
    r = table(spark, d, "region")
    a, b = r.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("first")), r.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("second"))
    return a.join(b, F.col("i") < F.col("j")).select("first", "second")


@query(
    "with named as (select n_name, row_number() over (order by n_name) - 1 as num_index from nation)"
    " select item_id, n_name from benchmark join named on item_id % (select count(*) from nation) = num_index"
)
def gather_by_index(spark, d):
    """Rows taken by the ordinal that a table of names stores."""
    named = with_row_index(spark, d)
    wanted = table(spark, d, "benchmark").crossJoin(named.agg(F.count("*").alias("n"))).select("item_id", (F.col("item_id") % F.col("n")).cast("int").alias("num_index"))
    return wanted.join(named, "num_index").select("item_id", "n_name")


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def column_slice(spark, d):
    """The first three columns by position, resolved to names."""
    orders = table(spark, d, "orders")
    return orders.select(orders.columns[:3])


@query("select event_id, event_type, value from events where event_type in (select event_type from events group by 1 having avg(value) > (select avg(value) from events))")
def channel_allow_list(spark, d):
    """Rows of the channels on a list that is itself a table."""
    events = table(spark, d, "events")
    means = events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    listed = means.crossJoin(events.agg(F.avg("value").alias("all"))).filter("mean > all").select("event_type")
    return events.join(listed, "event_type", "left_semi").select("event_id", "event_type", "value")


@query("select 'nation' as kind, n_name as label, n_regionkey as dims from nation union all select 'dim', 'dim_' || i, i from (select unnest(range(5))::int as i)")
def label_union(spark, d):
    """Region labels and one label per dimension in one list."""
    names = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("int").alias("dims"))
    dims = spark.range(5).select(F.lit("dim").alias("kind"), F.format_string("dim_%d", "id").alias("label"), F.col("id").cast("int").alias("dims"))
    return names.unionByName(dims)


@query("select source, lang, count(doc_id) as doc_id, count(text) as text, count(n_chars) as n_chars from documents group by 1, 2")
def group_count_nonnull(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(*[F.count(c).alias(c) for c in ("doc_id", "text", "n_chars")])


@query("select distinct lang from documents")
def distinct_values(spark, d):
    return table(spark, d, "documents").select("lang").distinct()


@query("select source, round(avg(case when lang = 'en' then 1.0::double else 0.0::double end), 6) as share from documents group by 1")
def proportion(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(R6(F.avg(F.coalesce((F.col("lang") == "en").cast("double"), F.lit(0.0)))).alias("share"))


@query("select c_mktsegment, round(median(c_acctbal), 6) as mid, round(quantile_cont(c_acctbal, 0.25), 6) as q1, round(quantile_cont(c_acctbal, 0.75), 6) as q3 from customer group by 1")
def demographics(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(R6(F.median("c_acctbal")).alias("mid"), R6(F.percentile("c_acctbal", 0.25)).alias("q1"), R6(F.percentile("c_acctbal", 0.75)).alias("q3"))


@query("select round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) as mean_loss from lineitem")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").agg(R6(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mean_loss"))


@query("select min(c_acctbal) as lo, max(c_acctbal) as hi from customer")
def minmax_bounds(spark, d):
    return table(spark, d, "customer").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("select c_nationkey, arg_min(c_name, c_custkey) as first_name from customer group by 1")
def first_by(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("first_name"))


@query("select lang, least(floor(n_chars / 500), 20)::bigint as bin, round(count(*) * 100.0::double / sum(count(*)) over (partition by lang), 6) as percent from documents group by 1, 2")
def hist_percent(spark, d):
    h = table(spark, d, "documents").groupBy("lang", F.least(F.floor(F.col("n_chars") / 500), F.lit(20)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return h.select("lang", "bin", R6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("lang"))).alias("percent"))


M = "select event_type as item, user_id % 3 as g, count(*) n, avg(value) mean, var_samp(value) var from events where value is not null group by 1, 2"
T = f"select a.item, a.g as group_a, b.g as group_b, a.n + b.n - 2 as df, (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) as t from ({M}) a join ({M}) b on a.item = b.item and a.g < b.g"


def _t(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 3).alias("g"), "value")
    return cohort.pooled_t(e, "item", "g", "value")


@query(f"select item, group_a, group_b, df, round(t, 6) as t from ({T})")
def ttest_pairs(spark, d):
    return _t(spark, d).withColumn("t", R6("t"))


@query()
def ttest_p_values(spark, d):
    """Two-sided p and its adjusted value over all tests as one family."""
    return cohort.benjamini_hochberg(_t(spark, d).withColumn("p", t_two_sided_p(F.col("t"), F.col("df"))), "p")


@query("with p as (select p_partkey as id, (p_size + p_partkey % 7 * 0.01) / 51 as p from part), r as (select *, row_number() over (order by p, id) k, count(*) over () m from p) select id, round(p, 9) as p, round(least(1.0, min(p * m / k) over (order by k desc rows unbounded preceding)), 9) as q from r")
def fdr_bh(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") + F.col("p_partkey") % 7 * 0.01) / 51).alias("p"))
    return cohort.benjamini_hochberg(p, "p").select("id", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("with r as (select l_returnflag g, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 a, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 b from lineitem) select g, round(corr(a, b), 6) as rho from r group by g")
def spearman_cross(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    x = cohort.average_rank(cohort.average_rank(x, ["g"], "l_quantity", "a"), ["g"], "l_extendedprice", "b")
    return x.groupBy("g").agg(R6(F.corr("a", "b")).alias("rho"))


_RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r{i}" for i, c in enumerate(("s_acctbal", "s_nationkey", "s_suppkey", "s_suppkey % 7")))
_RHO = " union all ".join(f"select '{a}' as l, '{b}' as r, count(*) as n, corr(r{i}, r{j}) as rho from k" for i, a in enumerate(("balance", "nation")) for j, b in ((2, "key"), (3, "weekday")))


@query(
    f"with k as (select {_RANKS} from supplier), c as ({_RHO}),"
    " t as (select *, n - 2 as df, atan(abs(rho * sqrt((n - 2) / (1 - rho * rho))) / sqrt(n - 2)) as a from c),"
    " e as (select j, exp(sum(ln((2.0::double * j - 1) / (2 * j))) over (order by j)) as even, exp(sum(ln(2.0::double * j / (2 * j + 1))) over (order by j)) as odd from (select unnest(range(1, 10000)) as j)),"
    " s as (select l, r, sum(case when df % 2 = 0 then even else odd end * pow(cos(a), 2 * j)) as s from t join e on j <= (case when df % 2 = 0 then df - 2 else df - 3 end) // 2 group by 1, 2)"
    " select l as left, r as right, n, round(rho, 6) as rho,"
    " round(1 - case when df % 2 = 0 then sin(a) * (1 + coalesce(s, 0)) when df = 1 then 2 * a / pi() else 2 / pi() * (a + sin(a) * cos(a) * (1 + coalesce(s, 0))) end, 6) as p"
    " from t left join s using (l, r)".replace("as left", 'as "left"').replace("as right", 'as "right"')
)
def spearman_block(spark, d):
    """Rank correlations between two blocks of columns, with p."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 7).alias("weekday"))
    out = cohort.spearman_block(s, "s_suppkey", ["balance", "nation"], ["key", "weekday"])
    rho = F.signum("rho") * R6(F.abs("rho"))  # a small negative one becomes -0.0, as in the SQL
    return out.select("left", "right", "n", rho.alias("rho"), R6("p").alias("p"))


@query("select label, count(*) as n from embeddings group by 1")
def group_sizes(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("select doc_id, case when quality is not null then 'ok' else 'error' end as status from documents left join labels using (doc_id)")
def dead_letter(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return status(x, F.col("quality").isNotNull()).select("doc_id", "status")


@query("select c_custkey as id, 'customer' as cohort from customer union all select s_suppkey, 'supplier' from supplier")
def union_cohorts(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("cohort"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("cohort")))


@query("select page_id, array_to_string(string_split(string_split(url, '/')[-1], '-')[1:2], '-') as subject_key from pages")
def subject_key(spark, d):
    name = F.element_at(F.split("url", "/"), -1)
    return table(spark, d, "pages").select("page_id", F.array_join(F.slice(F.split(name, "-"), 1, 2), "-").alias("subject_key"))


@query("select page_id, string_split(string_split(url, '/')[-2], '.')[-1] as grp from pages")
def group_from_path(spark, d):
    return table(spark, d, "pages").select("page_id", F.element_at(F.split(F.element_at(F.split("url", "/"), -2), r"\."), -1).alias("grp"))


@query("select page_id, replace(url, 'http', 'file') as u from pages")
def str_replace(spark, d):
    return table(spark, d, "pages").select("page_id", F.replace("url", F.lit("http"), F.lit("file")).alias("u"))


@query("select o_orderkey, string_split(o_orderpriority, '-')[1] as p from orders")
def str_prefix(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("p"))


@query("select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'HOUSEHOLD' then 3 when 'MACHINERY' then 4 end as code from customer")
def recode_ordinal(spark, d):
    codes = {k: i for i, k in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])}
    return table(spark, d, "customer").select("c_custkey", cohort.recode(F.col("c_mktsegment"), codes).alias("code"))


@query("select doc_id, case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 end as code from documents")
def recode_group(spark, d):
    return table(spark, d, "documents").select("doc_id", cohort.recode(F.col("lang"), {"en": 1, "fr": 2, "de": 3}).alias("code"))


@query("select distinct lang, cast(dense_rank() over (order by o) - 1 as int) as code from (select lang, min(doc_id) over (partition by lang) o from documents)")
def factorize(spark, d):
    return cohort.factorize(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id").select("lang", "code").distinct()


@query("select p_partkey, round(log10(p_retailprice), 6) as lg, abs(p_size - 25) as dist, round(exp(0.5 * p_size / 50), 6) as sd, round(1 / power(p_size, 2), 9) as inv from part")
def math_scalar(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", R6(F.log10("p_retailprice")).alias("lg"), F.abs(s - 25).alias("dist"), R6(F.exp(s * 0.5 / 50)).alias("sd"), F.round(1 / F.pow(s, F.lit(2)), 9).alias("inv"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_custkey) r from customer) where r <= 40")
def first_n_per_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, d, "customer").withColumn("r", F.row_number().over(w)).filter("r <= 40").select("c_nationkey", "c_custkey")


@query("select n_name, round(360.0 * (row_number() over (order by n_regionkey, n_name) - 1) / count(*) over (), 6)::double as angle from nation")
def order_labels(spark, d):
    n = table(spark, d, "nation").withColumn("k", F.row_number().over(Window.orderBy("n_regionkey", "n_name")) - 1)
    return n.select("n_name", R6(F.col("k") * F.lit(360.0) / F.count("*").over(Window.partitionBy())).alias("angle"))


@query("select arg_min(p_partkey, struct_pack(a := abs(p_retailprice - 1000), b := p_partkey)) as best from part")
def param_argmin(spark, d):
    return table(spark, d, "part").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_retailprice") - 1000), "p_partkey")).alias("best"))


@query("select label, round(avg(pow(embedding[1]::double - embedding[2]::double, 2)), 9) as mse from embeddings group by 1")
def mse(spark, d):
    e = table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    return e.groupBy("label").agg(F.round(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2))), 9).alias("mse"))


@query()
def kmeans_groups(spark, d):
    """k-means over the latents."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=3, seed=42).fit(x).transform(x).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def pca_2d(spark, d):
    """Two principal components of the centred latents."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("raw"))
    x = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(x).transform(x)
    return PCA(k=2, inputCol="centred", outputCol="pc").fit(x).transform(x).select("vec_id", vector_to_array("pc").alias("pc"))
