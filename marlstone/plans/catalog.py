"""Queries of the engine over the star-schema tables, each with the DuckDB SQL that must give the same rows.

The tables hold no listings, so they are bound to them: parts as raw listings, events and orders as observations,
conversations as review chains. The bindings below say how; the oracles repeat them in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone import policies
from marlstone.functions import parsing
from marlstone.functions.outcomes import outcome
from marlstone.operators import assessment, blocking, history, metrics, normalize, review, search
from marlstone.operators.ordering import placed
from marlstone.sources.store import Store
from marlstone.sources.tables import shared_dir, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Pairs of a bucket, at most, in the queries below.
LIMIT = 10


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Parts as raw listings.

_RAW_PARTS = """
  select cast(p_partkey as int) record_index, 'brand_' || regexp_replace(p_brand, 'Brand#', '') source_id, cast(p_partkey as string) publication_id,
    'https://listings.fixture.example/offers/' || cast(p_partkey as string) url,
    '2026-01-0' || cast(1 + p_partkey % 9 as string) || 'T01:30:00.5+03:00' observed_at,
    '  ' || replace(p_name, ' ', '   ') || ' ' location_text,
    case when p_partkey % 10 <= 7 then cast(cast(p_retailprice as decimal(18,2)) as string) end price_major,
    case when p_partkey % 10 < 7 then 'RUB' when p_partkey % 10 = 7 then 'USD' end currency,
    case when p_partkey % 11 <> 0 then cast(p_size as string) end total_area_sqm,
    case when p_partkey % 7 = 0 then 'studio' when p_partkey % 7 <> 6 then '0' || cast(p_partkey % 7 as string) end rooms
  from part"""

#: The same in SQL, as normalization must give it.
_LST = """
lst as (
  select 'brand_' || replace(p_brand, 'Brand#', '') source_id, cast(p_partkey as varchar) publication_id, p_partkey, p_name loc,
    'https://listings.fixture.example/offers/' || cast(p_partkey as varchar) url,
    make_timestamp(2025, 12, 31, 22, 30, 0.5) + to_days(cast(p_partkey % 9 as int)) seen,
    case when p_partkey % 10 <= 7 then cast(cast(p_retailprice as decimal(18,2)) * 100 as bigint) end price,
    case when p_partkey % 10 < 7 then 'RUB' end cur,
    case when p_partkey % 10 < 7 then 'present' when p_partkey % 10 = 7 then 'unsupported' else 'missing' end cur_state,
    case when p_partkey % 11 <> 0 then cast(p_size * 100 as bigint) end area,
    case when p_partkey % 7 <> 6 then cast(p_partkey % 7 as int) end rooms
  from part)"""


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    expressions = _RAW_PARTS.strip().removeprefix("select").rpartition("from part")[0]
    return part.selectExpr(*_split(expressions))


def _split(text: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(text[start:k])
                start = k + 1
    return [x.strip() for x in [*out, text[start:]]]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalized(raw_parts(spark, sf_dir)).drop("issues")


def part_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.available(parts(spark, sf_dir))


@query(f"""with {_LST} select publication_id, case when price is null then 'missing' else 'present' end price_state, price price_value, cur_state currency_state,
  cur currency_value, case when cur_state = 'unsupported' then 'unsupported_currency' end currency_reason from lst""")
def normalize_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = F.col("price_amount"), F.col("currency")
    return parts(spark, sf_dir).select(
        "publication_id", p["state"].alias("price_state"), p["value"].alias("price_value"), c["state"].alias("currency_state"),
        c["value"].alias("currency_value"), c["reason_code"].alias("currency_reason"),
    )


def _field(name: str) -> Query:
    return lambda spark, sf_dir: parts(spark, sf_dir).select("publication_id", F.col(f"{name}.state").alias("state"), F.col(f"{name}.value").alias("value"), F.col(f"{name}.raw_value").alias("raw"))


def _field_sql(value: str, raw: str) -> str:
    return f"with {_LST} select publication_id, case when {value} is null then 'missing' else 'present' end state, {value} as value, {raw} raw from lst"


QUERIES["normalize_area"] = _field("total_area")
ORACLE_SQL["normalize_area"] = _field_sql("area", "cast(area // 100 as varchar)")
QUERIES["normalize_rooms"] = _field("rooms")
ORACLE_SQL["normalize_rooms"] = _field_sql("rooms", "case when rooms = 0 then 'studio' when rooms is not null then '0' || cast(rooms as varchar) end")
QUERIES["normalize_location"] = _field("location_text")
ORACLE_SQL["normalize_location"] = _field_sql("loc", "'  ' || replace(loc, ' ', '   ') || ' '")


@query(f"""with {_LST} select case when area is null then 'missing' else 'present' end area_state, case when rooms is null then 'missing' else 'present' end rooms_state,
  cur_state currency_state, count(*) n from lst group by all""")
def normalize_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = [F.col(f"{a}.state").alias(f"{b}_state") for a, b in (("total_area", "area"), ("rooms", "rooms"), ("currency", "currency"))]
    return parts(spark, sf_dir).select(*states).groupBy("area_state", "rooms_state", "currency_state").agg(F.count(F.lit(1)).alias("n"))


#: One fault by the key's remainder: the field, its raw text ('' removes it), the issue.
_FAULTS = (
    ("price_major", "-1.00", "out_of_range"), ("price_major", "1.234", "invalid_value"), ("price_major", "92233720368547758.08", "out_of_range"),
    ("price_major", "1\n", "invalid_value"), ("currency", "rub", "invalid_value"), ("currency", "", "incomplete_money"), ("total_area_sqm", "1.005", "precision_loss"),
    ("total_area_sqm", "-1.005", "precision_loss"), ("total_area_sqm", "0.00", "out_of_range"), ("total_area_sqm", "1.500", None), ("rooms", "0", "invalid_value"),
    ("rooms", "100", "out_of_range"), ("rooms", "0099", None), ("location_text", " \t", "invalid_value"), ("observed_at", "2026-02-30T00:00:00Z", "invalid_value"),
    ("observed_at", "2026-02-01T00:00:00", "invalid_value"), ("observed_at", "2026-02-01T00:00:00+23:59", None), ("observed_at", "2026-02-01T24:00:00Z", "invalid_value"),
    ("url", "http://listings.fixture.example/", "invalid_value"), ("url", "https://u@listings.fixture.example/", "invalid_value"), ("url", "https://h:99999/", "invalid_value"),
)


def _faulty(name: str) -> Column:
    n = len(_FAULTS)
    out = F.col(name)
    if name in ("price_major", "currency"):  # money that is there in every record
        out = F.lit("7.00" if name == "price_major" else "RUB")
    for k, (field, raw, _) in enumerate(_FAULTS):
        if field == name:
            out = F.when(F.col("record_index") % n == k, F.lit(raw or None).cast("string")).otherwise(out)
    return out.alias(name)


@query(
    "select cast(p_partkey as int) record_index, f.code code, 'NORMALIZATION' category, '$.listings[' || p_partkey || ']' || case when f.code = 'incomplete_money' then '' else '.' || f.field end json_path from part join (values "
    + ", ".join(f"({k}, '{f}', '{c}')" for k, (f, _, c) in enumerate(_FAULTS) if c)
    + f") f(k, field, code) on p_partkey % {len(_FAULTS)} = f.k"
)
def normalize_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_parts(spark, sf_dir)
    broken = raw.select(*[_faulty(c) for c in raw.columns])
    return normalize.normalized(broken).select(F.explode("issues").alias("i")).select("i.record_index", "i.code", "i.category", "i.json_path")


@query(r"""select page_id, url is not null and length(url) <= 2048 and regexp_full_match(url, '(?i:https)://[^/?#:@\[\]\s]+(:[0-9]{0,4})?([/?][^#\s]*)?#?') as is_valid from pages""")
def url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = parsing.url(F.coalesce("url", F.lit("")))["code"]
    return table(spark, sf_dir, "pages").select("page_id", code.isNull().alias("is_valid"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') canonical from events")
def timestamp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments written in zones of many offsets and parsed back to UTC."""
    hours = F.pmod(F.col("event_id"), F.lit(40)) - 20
    local = F.col("ts") + F.make_dt_interval(F.lit(0), hours.cast("int"), F.when(hours < 0, -45).otherwise(45))
    zone = F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":45"))
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    read = table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", "text", parsing.moment.read(F.col("text")).alias("read"))
    return read.select("event_id", parsing.rendered_moment(parsing.moment.result(F.col("text"), F.col("read"))["value"]).alias("canonical"))


@query("""select record_index, source_id, publication_id, occurrence from (select cast(o_orderkey as int) record_index, 'orders' source_id, cast(o_custkey as varchar) publication_id,
  cast(row_number() over (partition by o_custkey order by cast(o_orderkey as int)) as int) occurrence from orders) where occurrence > 1""")
def collection_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("record_index"), F.lit("orders").alias("source_id"), F.col("o_custkey").cast("string").alias("publication_id"))
    return normalize.repeated_references(rows)


@query("""with raw as (select cast(p_partkey as int) record_index, 'brand_' || replace(p_brand, 'Brand#', '') source_id, cast(p_partkey % 1000 as varchar) publication_id from part)
  select record_index, 'COLLECTION_CONFLICT' category, 'duplicate_publication_ref' code, '$.listings[' || record_index || ']' json_path
  from (select *, row_number() over (partition by source_id, publication_id order by record_index) n from raw) where n > 1""")
def collection_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection in which publications come again: nothing else is wrong with the records."""
    raw = raw_parts(spark, sf_dir).withColumn("publication_id", F.pmod("record_index", F.lit(1000)).cast("string"))
    return normalize.collection(raw).conflicts.select("record_index", "category", "code", "json_path")


@query(f"with {_LST} select publication_id, (area // 100) || '.' || lpad(cast(area % 100 as varchar), 2, '0') area_text from lst")
def rendered_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("publication_id", parsing.rendered_area(F.col("total_area.value")).alias("area_text"))


@query("""select cast(p_partkey as varchar) publication_id, p_partkey % 5 not in (0, 1, 2) fits from part""")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' own URLs, of which some name another publication, have a query or a part too many."""
    k, own = F.pmod("record_index", F.lit(5)), F.col("url")
    url = F.when(k == 0, F.concat(own, F.lit("0"))).when(k == 1, F.concat(own, F.lit("?a=1"))).when(k == 2, F.concat(own, F.lit("/x"))).otherwise(own)
    return raw_parts(spark, sf_dir).select("publication_id", parsing.source_url(url, F.col("publication_id")).alias("fits"))


def _search(name: str, criteria: search.Criteria, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.ranked(parts(spark, sf_dir), criteria).select("rank", "source_id", "publication_id", F.col("price_amount.value").alias("price"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"""with {_LST} select row_number() over (order by case cur_state when 'present' then 0 when 'missing' then 1 else 2 end,
      case when cur_state = 'present' then cur else '' end, case when cur_state = 'present' then price else 0 end, source_id, publication_id, seen, url) rank,
      source_id, publication_id, price from lst where {where}"""


_search("search_none", search.Criteria(), "true")
_search("search_max_price", search.Criteria(max_price=120_000), "cur = 'RUB' and price <= 120000")
_search("search_min_area", search.Criteria(min_area=3000), "area >= 3000")
_search("search_rooms", search.Criteria(rooms=frozenset({0, 3, 42})), "rooms in (0, 3, 42)")
_search("search_all", search.Criteria(max_price=150_000, min_area=1000, rooms=frozenset({0, 1, 2})), "cur = 'RUB' and price <= 150000 and area >= 1000 and rooms in (0, 1, 2)")


# Events as observations.

_EVENT_FIELDS = ("location_text", "price_amount", "rooms")


def _present(value: Column, field: str) -> Column:
    return outcome(value.cast("string"), value, F.lit(f"$.{field}"), field, "event@1").alias(field)


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user: errors are unavailable, with the properties as evidence."""
    error = F.col("event_type") == "error"
    price = F.round(F.col("value") * 100).cast("bigint")
    rooms = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(100))
    listing = F.struct(_present(F.col("event_type"), "location_text"), _present(price, "price_amount"), _present(rooms, "rooms"))
    evidence = F.struct(F.lit("direct").alias("kind"), F.col("props").alias("raw_source_state"))
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("publication_id"), F.col("ts").alias("observed_at"),
        (~error).alias("is_available"), F.when(~error, listing).alias("listing"), F.when(error, evidence).alias("evidence"),
    )


_OBS = """
obs as (
  select cast(user_id as varchar) publication_id, ts, event_type, event_type <> 'error' av, cast(round(value * 100) as bigint) price,
    cast(json_extract_string(props, '$.k') as int) % 100 rooms, props from events),
steps as (
  select *, lag(ts) over w from_at, lag(event_type) over w p_type, lag(av) over w p_av, lag(price) over w p_price, lag(rooms) over w p_rooms, lag(props) over w p_props
  from obs window w as (partition by publication_id order by ts))"""


def _event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes(event_observations(spark, sf_dir), _EVENT_FIELDS)


@query(f"with {_OBS} select publication_id, from_at, ts to_at from steps where from_at is not null")
def history_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_changes(spark, sf_dir).select("publication_id", "from_at", "to_at")


@query(f"""with {_OBS} select publication_id, from_at, ts to_at, case when p_av then 'confirmed_unavailable' else 'reappeared' end transition
  from steps where from_at is not null and p_av <> av""")
def availability_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_changes(spark, sf_dir).where("transition is not null").select("publication_id", "from_at", "to_at", "transition")


@query(f"""with {_OBS} select 'duplicate_publication_ref' code, publication_id, null::timestamp observed_at, cast(count(*) as int) repeats from obs where av group by publication_id having count(*) > 1
  union all select distinct 'observation_not_available', publication_id, ts, null::int from obs where not av""")
def input_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as if they were current observations: what keeps them from being that."""
    found = blocking.input_conflicts(event_observations(spark, sf_dir))
    return found.select("code", "publication_id", "observed_at", F.when(F.col("keys").isNotNull(), F.size("keys")).alias("repeats"))


@query("""with steps as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by md5(cast(event_id as varchar)), event_id) previous_at from events)
  select cast(user_id as varchar) publication_id, ts observed_at, previous_at from steps where previous_at >= ts""")
def out_of_order_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in another order than they happened."""
    ordinal = F.struct(F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"), "event_id").alias("ordinal")
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("publication_id"), F.col("ts").alias("observed_at"), ordinal)
    return history.out_of_order(rows).select("publication_id", "observed_at", "previous_at")


_DELTAS = """
deltas as (
  select publication_id, ts to_at, unnest([case when p_type <> event_type then 'location_text' end, case when p_price <> price then 'price_amount' end,
    case when p_rooms <> rooms then 'rooms' end]) field from steps where from_at is not null and p_av and av)"""


@query(f"with {_OBS}, {_DELTAS} select publication_id, to_at, field, 'SUBSTANTIVE' kind from deltas where field is not null")
def field_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_changes(spark, sf_dir).select("publication_id", "to_at", F.explode("deltas").alias("d")).select("publication_id", "to_at", "d.field", "d.kind")


@query(f"with {_OBS}, {_DELTAS} select field, 'SUBSTANTIVE' kind, count(*) n from deltas where field is not null group by field")
def delta_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_deltas(spark, sf_dir).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_OBS} select publication_id, from_at, ts to_at from steps where from_at is not null and not p_av and not av and p_props <> props")
def evidence_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_changes(spark, sf_dir).where("evidence_changed").select("publication_id", "from_at", "to_at")


@query(f"with {_OBS} select publication_id, max(ts) observed_at, arg_max(av, ts) is_available, arg_max(case when av then price end, coalesce(ts)) price from obs group by 1")
def history_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.heads(event_observations(spark, sf_dir)).select("publication_id", "observed_at", "is_available", F.col("listing.price_amount.value").alias("price"))


ORACLE_SQL["history_heads"] = f"""with {_OBS}, last as (select *, row_number() over (partition by publication_id order by ts desc) n from obs)
  select publication_id, ts observed_at, av is_available, case when av then price end price from last where n = 1"""


@query("""with cut as (select quantile_disc(ts, 0.5) t from events), g as (select user_id, max(ts) generation_at from events, cut where ts < t and user_id % 10 <> 0 group by 1),
  c as (select user_id, max(ts) current_at from events where user_id % 7 <> 0 and event_type <> 'error' group by 1)
  select cast(coalesce(g.user_id, c.user_id) as varchar) publication_id, generation_at, current_at, case when current_at is null then 'MISSING_GENERATION_KEY'
  when generation_at is null then 'EXTRA_CURRENT_KEY' else 'CURRENT_KEY_MISMATCH' end kind from g full join c on g.user_id = c.user_id
  where generation_at is null or current_at is null or generation_at <> current_at""")
def generation_current_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a generation made at the median moment against the latest available ones."""
    rows = event_observations(spark, sf_dir)
    user = F.col("publication_id").cast("long")
    cut = table(spark, sf_dir, "events").agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(ts :: timestamp))").alias("t"))
    early = rows.where(user % 10 != 0).join(F.broadcast(cut), F.unix_micros(F.col("observed_at").cast("timestamp")) < F.col("t"))
    generation = early.groupBy(*history.REF).agg(F.max("observed_at").alias("observed_at"))
    current = rows.where((user % 7 != 0) & F.col("is_available")).groupBy(*history.REF).agg(F.max("observed_at").alias("observed_at"))
    return assessment.key_mismatches(generation, current).select("publication_id", "generation_at", "current_at", "kind")


@query(f"""with {_OBS}, cut as (select quantile_disc(ts, 0.5) t from events), last as (select publication_id, max(ts) observed_at from obs where publication_id in ('1', '2', '3') group by 1)
  select publication_id, observed_at, case when publication_id <> '1' then 'stream_reference_mismatch' when observed_at < t then 'REPLAYED' else 'APPENDED' end decision from last, cut""")
def append_one_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One publication's history until the median moment, to which its last observation and those of two others are offered."""
    rows = event_observations(spark, sf_dir)
    cut = table(spark, sf_dir, "events").agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(ts :: timestamp))").alias("t"))
    early = rows.join(F.broadcast(cut), F.unix_micros(F.col("observed_at").cast("timestamp")) < F.col("t")).drop("t")
    offered = history.heads(rows.where(F.col("publication_id").isin("1", "2", "3")))
    done = history.append_one(early, ("events", "1"), offered, fields=_EVENT_FIELDS)
    outcomes = done.outcomes.select("publication_id", "observed_at", F.col("disposition").alias("decision"))
    return outcomes.unionByName(done.conflicts.select("publication_id", "observed_at", F.col("code").alias("decision")))


# Orders as observations, appended in a batch.

_ORD = """
ord as (
  select cast(o_custkey as varchar) publication_id, o_custkey, o_orderkey, o_orderdate seen, o_orderstatus st, cast(round(o_totalprice * 100) as bigint) price from orders),
cut as (select quantile_disc(seen, 0.5) t from ord),
hist as (
  select publication_id, o_custkey, seen, st, price from (select *, row_number() over (partition by publication_id, seen order by o_orderkey) n from ord, cut where seen < t) where n = 1 and o_orderkey % 19 <> 0),
batch as (
  select distinct publication_id, seen, st, price from (
    select publication_id, seen, st, price from ord, cut where seen >= t or o_orderkey % 19 = 0
    union all select publication_id, seen, st, price from hist where o_custkey % 10 = 0)),
keyed as (select *, count(*) over (partition by publication_id, seen) contents from batch),
judged as (
  select k.publication_id, k.seen, case when o.seen is not null and o.st = k.st and o.price = k.price then 'REPLAYED' when o.seen is not null then 'timestamp_content_conflict'
    when k.seen < l.latest then 'out_of_order_observation' else 'APPENDED' end disposition
  from (select * from keyed where contents = 1) k left join hist o on o.publication_id = k.publication_id and o.seen = k.seen
  left join (select publication_id, max(seen) latest from hist group by 1) l on l.publication_id = k.publication_id)"""


def _order_batch(spark: SparkSession, sf_dir: str) -> history.Append:
    orders = table(spark, sf_dir, "orders")
    cut = orders.agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(o_orderdate :: timestamp))").alias("t"))
    price = F.round(F.col("o_totalprice") * 100).cast("bigint")
    listing = F.struct(F.struct(F.lit("present").alias("state"), F.col("o_orderstatus").alias("value")).alias("location_text"), F.struct(F.lit("present").alias("state"), price.alias("value")).alias("price_amount"))
    rows = orders.select(
        F.lit("orders").alias("source_id"), F.col("o_custkey").cast("string").alias("publication_id"), F.col("o_orderdate").alias("observed_at"), F.lit(True).alias("is_available"),
        listing.alias("listing"), F.lit(None).cast("string").alias("evidence"), "o_orderkey", "o_custkey",
    ).join(F.broadcast(cut))
    old = F.unix_micros(F.col("observed_at").cast("timestamp")) < F.col("t")
    first = F.row_number().over(Window.partitionBy("publication_id", "observed_at").orderBy("o_orderkey"))
    known = rows.where(old).withColumn("n", first).where("n = 1 and o_orderkey % 19 <> 0")
    keep = [*history.KEY, *history.CONTENT]
    batch = rows.where(~old | (F.col("o_orderkey") % 19 == 0)).select(*keep).unionByName(known.where("o_custkey % 10 = 0").select(*keep))
    return history.append(known.select(*keep), batch, fields=())


@query(f"with {_ORD} select publication_id, seen observed_at, disposition from judged where disposition in ('APPENDED', 'REPLAYED')")
def append_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_batch(spark, sf_dir).outcomes.select("publication_id", "observed_at", "disposition")


@query(f"""with {_ORD} select publication_id, seen observed_at, disposition code from judged where disposition not in ('APPENDED', 'REPLAYED')
  union select publication_id, seen, 'timestamp_content_conflict' from keyed where contents > 1""")
def append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_batch(spark, sf_dir).conflicts.select("publication_id", "observed_at", "code")


@query(f"""with {_ORD}, new as (select publication_id, seen from judged where disposition = 'APPENDED'), whole as (select publication_id, seen from hist union all select publication_id, seen from new),
  steps as (select publication_id, lag(seen) over (partition by publication_id order by seen) from_at, seen to_at from whole)
  select s.publication_id, from_at, to_at from steps s join new n on n.publication_id = s.publication_id and n.seen = s.to_at where from_at is not null""")
def append_change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_batch(spark, sf_dir).change_sets.select("publication_id", "from_at", "to_at")


# Blocking and evidence on parts.

_MEM = f"""{_LST},
mem as (
  select source_id, publication_id, seen, 0 rule_pos, area total_area, rooms, null location_text from lst where area is not null and rooms is not null
  union all select source_id, publication_id, seen, 1, area, null, loc from lst where area is not null),
buckets as (
  select rule_pos, total_area, rooms, location_text, count(*) members, count(*) * (count(*) - 1) // 2 pairs from mem group by all),
cand as (
  select l.source_id left_source_id, l.publication_id left_publication_id, r.source_id right_source_id, r.publication_id right_publication_id, l.seen left_at, r.seen right_at,
    count(*) routes, min(l.rule_pos) first_route
  from mem l join mem r on l.rule_pos = r.rule_pos and l.total_area = r.total_area and l.rooms is not distinct from r.rooms and l.location_text is not distinct from r.location_text
    and (l.source_id < r.source_id or l.source_id = r.source_id and l.publication_id < r.publication_id)
  join buckets b on b.rule_pos = l.rule_pos and b.total_area = l.total_area and b.rooms is not distinct from l.rooms and b.location_text is not distinct from l.location_text
  where b.pairs <= {LIMIT} group by all)"""


def _generation(spark: SparkSession, sf_dir: str) -> blocking.Generation:
    return blocking.generate(part_observations(spark, sf_dir), LIMIT)


@query(f"with {_MEM} select source_id, publication_id, rule_pos, total_area, rooms, location_text from mem")
def blocking_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generation(spark, sf_dir).members.select("source_id", "publication_id", "rule_pos", "total_area", "rooms", "location_text")


@query(f"""with {_LST} select publication_id, 0 rule_pos, unnest(list_filter([case when area is null then 'total_area' end, case when rooms is null then 'rooms' end], lambda x: x is not null)) field, 'missing' state from lst
  union all select publication_id, 1, 'total_area', 'missing' from lst where area is null""")
def blocking_nonparticipation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generation(spark, sf_dir).non_participations
    return rows.select("publication_id", "rule_pos", F.explode("reasons").alias("r")).select("publication_id", "rule_pos", "r.field", "r.state")


@query(f"with {_MEM} select rule_pos, total_area, rooms, location_text, members, cast(pairs as bigint) pairs from buckets where pairs > {LIMIT}")
def blocking_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generation(spark, sf_dir).oversized.drop("reason_code")


@query(f"with {_MEM} select left_source_id, left_publication_id, right_source_id, right_publication_id, cast(routes as int) routes, first_route from cand")
def blocking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generation(spark, sf_dir).rows
    return rows.select(*blocking.IDENTITY[:4], F.size("matches").alias("routes"), F.col("matches")[0]["rule_pos"].alias("first_route"))


@query(f"""with {_MEM} select left_source_id, left_publication_id, right_source_id, right_publication_id,
  row_number() over (order by left_source_id, left_publication_id, right_source_id, right_publication_id, left_at, right_at) rank from cand""")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(_generation(spark, sf_dir).rows.select(*blocking.IDENTITY), *blocking.candidate_order()).select(*blocking.IDENTITY[:4], "rank")


@query(f"""with {_LST}, away as (select source_id, publication_id, seen, 0 rule_pos from lst where area is null or rooms is null union all select source_id, publication_id, seen, 1 from lst where area is null)
  select source_id, publication_id, rule_pos, row_number() over (order by source_id, publication_id, seen, rule_pos) rank from away""")
def non_participation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generation(spark, sf_dir).non_participations
    return placed(rows, *blocking.non_participation_order()).select("source_id", "publication_id", "rule_pos", "rank")


_DOC = """
doc as (select doc_id, lang, n_chars, md5(text) h from documents where text is not null),
small as (select lang, n_chars, count(*) members from doc group by all having count(*) > 1 and count(*) * (count(*) - 1) // 2 <= 15)"""


@query(f"""with {_DOC} select l.doc_id left_id, r.doc_id right_id, l.h = r.h same_text from doc l join doc r on l.lang = r.lang and l.n_chars = r.n_chars and l.doc_id < r.doc_id
  join small s on s.lang = l.lang and s.n_chars = l.n_chars""")
def document_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents blocked by language and length, buckets of more than 15 pairs left out: texts stay out of the shuffle."""
    doc = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "n_chars", F.md5("text").alias("h"))
    n = F.col("members")
    usable = doc.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("members")).where((n > 1) & (F.shiftright(n * (n - 1), 1) <= 15))
    kept = doc.join(usable, ["lang", "n_chars"], "left_semi")
    left, right = kept.alias("l"), kept.alias("r")
    on = (F.col("l.lang") == F.col("r.lang")) & (F.col("l.n_chars") == F.col("r.n_chars")) & (F.col("l.doc_id") < F.col("r.doc_id"))
    return left.join(right, on).select(F.col("l.doc_id").alias("left_id"), F.col("r.doc_id").alias("right_id"), (F.col("l.h") == F.col("r.h")).alias("same_text"))


_FOUND = f"""{_MEM},
pairs as (
  select c.left_publication_id, c.right_publication_id, c.left_source_id, c.right_source_id, c.left_at, c.right_at, l.area la, r.area ra, l.rooms lr, r.rooms rr, l.loc ll, r.loc rl, l.price lp, r.price rp, l.cur lc, r.cur rc
  from cand c join lst l on l.publication_id = c.left_publication_id join lst r on r.publication_id = c.right_publication_id),
verdicts as (
  select *, case when la is null or ra is null then 'not_comparable_total_area' when la = ra then 'exact_total_area' else 'different_total_area' end v0,
    case when lr is null or rr is null then 'not_comparable_rooms' when lr = rr then 'exact_room_count' else 'different_room_count' end v1,
    case when ll = rl then 'exact_location_text' else 'free_text_mismatch_is_neutral' end v2,
    case when lp is null or rp is null or lc is null or rc is null then 'not_comparable_price' when lc <> rc then 'currency_difference_is_neutral'
      when lp = rp then 'exact_price_same_currency' else 'price_difference_is_neutral' end v3
  from pairs),
outcomes as (
  select *, case when not (v0 = 'exact_total_area' and (v1 = 'exact_room_count' or v2 = 'exact_location_text')) then 'INSUFFICIENT_EVIDENCE_NO_CANDIDATE'
    when v1 = 'different_room_count' then 'CONFLICTING_EVIDENCE_REQUIRES_MANUAL_REVIEW' else 'CANDIDATE_REQUIRES_MANUAL_REVIEW' end outcome from verdicts)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.assess_batch(_generation(spark, sf_dir), part_observations(spark, sf_dir)).rows


@query(f"""with {_FOUND}, rows as (select left_publication_id, right_publication_id, unnest(['total-area-comparison', 'rooms-comparison', 'location-text-exact', 'price-exact']) rule_id, unnest([v0, v1, v2, v3]) reason_code from verdicts)
  select *, case when starts_with(reason_code, 'exact') then 'SUPPORTS' when starts_with(reason_code, 'different') then 'CONTRADICTS' end polarity,
  case when reason_code in ('exact_total_area', 'different_total_area', 'different_room_count') then 'MATERIAL' when reason_code in ('exact_room_count', 'exact_location_text') then 'CORROBORATING'
  when reason_code = 'exact_price_same_currency' then 'AUXILIARY' end strength from rows""")
def pair_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assessed(spark, sf_dir).select("left_publication_id", "right_publication_id", F.explode(F.concat("evidence", "non_comparisons")).alias("f"))
    return rows.select("left_publication_id", "right_publication_id", "f.rule_id", "f.reason_code", "f.polarity", "f.strength")


@query(f"with {_FOUND} select left_publication_id, right_publication_id, outcome from outcomes")
def pair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assessed(spark, sf_dir).select("left_publication_id", "right_publication_id", "outcome")


@query(f"""with {_FOUND} select left_publication_id, right_publication_id, cast(left_publication_id as bigint) % 5 <> 0 and cast(right_publication_id as bigint) % 5 <> 0
  and cast(left_publication_id as bigint) % 3 <> 0 and cast(right_publication_id as bigint) % 3 <> 0 is_current from outcomes""")
def assessment_current_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against current keys in which every fifth publication is gone and every third was observed anew."""
    pid = F.col("publication_id").cast("long")
    now = parts(spark, sf_dir).where(pid % 5 != 0).select(*history.REF, F.when(pid % 3 == 0, F.col("observed_at") + F.expr("interval 1 day")).otherwise(F.col("observed_at")).alias("observed_at"))
    return assessment.is_current(_assessed(spark, sf_dir), now).select("left_publication_id", "right_publication_id", "is_current")


@query(f"""with {_FOUND} select left_publication_id, right_publication_id, 'tampered with' stored, outcome expected from outcomes where cast(left_publication_id as bigint) % 3 = 0""")
def tampered_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored assessments, of which every third outcome was changed, against those that follow from the observations."""
    rows = written(part_observations(spark, sf_dir))
    done = assessment.assess_batch(blocking.generate(rows, LIMIT), rows).rows.select(*review.ASSESSMENT, "evidence", "non_comparisons", "outcome")
    stored = done.withColumn("outcome", F.when(F.col("left_publication_id").cast("long") % 3 == 0, "tampered with").otherwise(F.col("outcome")))
    return assessment.tampered(stored, rows).select("left_publication_id", "right_publication_id", "stored", "expected")


@query(f"""with {_MEM}, drafts as (select *, cast(left_publication_id as bigint) k from cand)
  select left_publication_id, right_publication_id, case when k % 7 = 0 then 'review_assessment_mismatch' when k % 6 = 0 then 'CREATED' when k % 10 = 0 then 'review_identity_content_conflict'
    when k % 2 = 0 then 'REPLAYED' when k % 3 = 0 then 'review_revision_mismatch' else 'CREATED' end decision from drafts""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of reviews of all candidates: new ones, later revisions, repeats, changed repeats, and such without their assessment."""
    rows = written(part_observations(spark, sf_dir))
    done = written(assessment.assess_batch(blocking.generate(rows, LIMIT), rows).rows.select(*review.ASSESSMENT, "evidence", "non_comparisons"))
    k, area = F.col("left_publication_id").cast("long"), policies.EVIDENCE_RULES[0]
    moment = lambda day: F.lit(f"2026-03-0{day} 00:00:00").cast("timestamp")
    reference = F.struct(
        F.lit("EVIDENCE").alias("kind"), F.lit(0).alias("ordinal"), F.lit(area.rule_id).alias("rule_id"), F.lit(area.version).alias("rule_version"), F.lit(assessment.SUPPORTS).alias("polarity")
    )

    def reviews(pairs: DataFrame, second: Column, outcome_: Column) -> DataFrame:
        own = {c: F.col(c) for c in review.ASSESSMENT}
        code = F.concat_ws("-", "left_source_id", "left_publication_id", "right_source_id", "right_publication_id")
        made = {
            "code": code, "revision": F.when(second, 2).otherwise(1), **own, "reviewed_at": F.when(second, moment(2)).otherwise(moment(1)), "reviewer": F.lit("reviewer"), "outcome": outcome_,
            "rationale_codes": F.array(F.lit("looked_alike")), "references": F.array(reference), "supersedes_code": F.when(second, code), "supersedes_revision": F.when(second, 1),
        }
        return pairs.select(*[c.alias(n) for n, c in made.items()])

    confirmed, rejected = F.lit(metrics.CONFIRMED), F.lit(metrics.REJECTED)
    stored = reviews(done.where(k % 2 == 0), F.lit(False), confirmed)
    drafts = reviews(done, k % 3 == 0, F.when((k % 10 == 0) & (k % 3 != 0), rejected).otherwise(confirmed))
    drafts = drafts.withColumn("left_at", F.when(k % 7 == 0, F.col("left_at") + F.expr("interval 1 day")).otherwise(F.col("left_at")))
    return review.create(drafts, done, stored).select("left_publication_id", "right_publication_id", "decision")


# Labelled pairs: all candidates, and neighbours by key that blocking may have missed.

_CASES = f"""{_FOUND},
near as (
  select l.source_id ls, l.publication_id lpid, r.source_id rs, r.publication_id rpid, l.p_partkey lk, r.p_partkey rk, l.area la, r.area ra, l.rooms lr, r.rooms rr, l.loc ll, r.loc rl, l.cur lc, r.cur rc, l.price lp, r.price rp
  from lst l join lst r on r.p_partkey = l.p_partkey + 7 * (1 + l.p_partkey % 3)),
named as (
  select case when (ls, lpid) < (rs, rpid) then ls else rs end left_source_id, case when (ls, lpid) < (rs, rpid) then lpid else rpid end left_publication_id,
    case when (ls, lpid) < (rs, rpid) then rs else ls end right_source_id, case when (ls, lpid) < (rs, rpid) then rpid else lpid end right_publication_id, *
  from near),
cases as (
  select *, lk % 23 = 0 not_assessed, case when lk % 5 = 0 then 'REJECTED_RELATIONSHIP' else 'CONFIRMED_RELATIONSHIP' end label,
    case when not (coalesce(la = ra, false) and (coalesce(lr = rr, false) or ll = rl)) then 'INSUFFICIENT_EVIDENCE_NO_CANDIDATE'
      when coalesce(lr <> rr, false) then 'CONFLICTING_EVIDENCE_REQUIRES_MANUAL_REVIEW' else 'CANDIDATE_REQUIRES_MANUAL_REVIEW' end outcome from named),
counts as (
  select count(*) population, count(*) filter (where not not_assessed) assessed, count(*) filter (where not_assessed) not_assessed, count(*) filter (where not not_assessed and outcome like 'CANDIDATE%') candidate,
    count(*) filter (where not not_assessed and outcome like 'CONFLICTING%') conflicting, count(*) filter (where not not_assessed and outcome like 'INSUFF%') insufficient,
    count(*) filter (where label = 'CONFIRMED_RELATIONSHIP') confirmed, count(*) filter (where label = 'REJECTED_RELATIONSHIP') rejected, cast(0 as bigint) inconclusive,
    count(*) filter (where not not_assessed and outcome not like 'INSUFF%') review_required, count(*) filter (where not not_assessed and outcome not like 'INSUFF%' and label = 'CONFIRMED_RELATIONSHIP') review_confirmed
  from cases)"""


def control_cases(rows: DataFrame) -> DataFrame:
    """Parts some keys apart as labelled pairs; every 23rd wasn't assessed, every fifth label rejects. ``rows``: parts as observations."""
    side = lambda n: F.struct(*history.KEY, "is_available", "listing").alias(n)
    own = F.col("publication_id").cast("long")
    left = rows.select(own.alias("k"), (own + 7 * (1 + own % 3)).alias("other"), side("first"))
    right = rows.select(own.alias("other"), side("second"))
    pairs = left.join(right, "other").withColumn("first", F.col("first").withField("is_available", F.col("k") % 23 != 0))
    ref = lambda c: F.struct(F.col(f"{c}.source_id"), F.col(f"{c}.publication_id"))
    ordered = ref("first") < ref("second")
    listing = lambda a, b: F.when(ordered, F.col(f"{a}.listing")).otherwise(F.col(f"{b}.listing"))
    labels = pairs.select(F.least(ref("first"), ref("second")).alias("l"), F.greatest(ref("first"), ref("second")).alias("r"), "k", listing("first", "second").alias("left"), listing("second", "first").alias("right"))
    labels = labels.select(
        F.col("l.source_id").alias("left_source_id"), F.col("l.publication_id").alias("left_publication_id"), F.col("r.source_id").alias("right_source_id"),
        F.col("r.publication_id").alias("right_publication_id"), "left", "right", F.when(F.col("k") % 5 == 0, metrics.REJECTED).otherwise(metrics.CONFIRMED).alias("label"),
    )
    return assessment.assess_pairs(pairs).withColumnRenamed("assessment_policy", "policy_version").join(labels, list(metrics.PAIR))


@query(f"with {_CASES} select population, assessed, not_assessed, candidate, conflicting, insufficient, confirmed, rejected, inconclusive, review_required, review_confirmed from counts")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality(control_cases(written(part_observations(spark, sf_dir)))).drop("precision", "recall", "assessment_coverage", "review_load", "review_inconclusive")


@query(f"""with {_CASES} select unnest(['assessment_coverage', 'precision', 'recall', 'review_load']) metric, unnest([assessed, review_confirmed, review_confirmed, review_required]) numerator,
  unnest([population, review_required, confirmed, population]) denominator from counts""")
def quality_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("assessment_coverage", "precision", "recall", "review_load")
    rows = metrics.quality(control_cases(written(part_observations(spark, sf_dir)))).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("m")) for n in names])).alias("x"))
    return rows.select("x.metric", "x.m.numerator", "x.m.denominator")


@query(f"""with {_CASES} select left_source_id, left_publication_id, right_source_id, right_publication_id,
  row_number() over (order by left_source_id, left_publication_id, right_source_id, right_publication_id) rank from cases""")
def control_case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(control_cases(written(part_observations(spark, sf_dir))).select(*metrics.PAIR), *metrics.case_order())


@query(f"""with {_CASES}, bad as (select cast(left_publication_id as bigint) k from cases)
  select 'unsupported_label' code, count(*) n from bad where k % 4 = 0 having count(*) > 0 union all select 'policy_version_mismatch', count(*) from bad where k % 9 = 0 having count(*) > 0
  union all select 'duplicate_pair', 2 * count(*) from bad where k % 6 = 0 having count(*) > 0""")
def control_set_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control cases with odd labels, another policy's results and repeats: how many of each."""
    rows = control_cases(written(part_observations(spark, sf_dir))).select(*metrics.PAIR, "policy_version", "result", "label")
    k = F.col("left_publication_id").cast("long")
    again = rows.where(k % 6 == 0).withColumns({"label": F.lit(metrics.CONFIRMED), "policy_version": F.lit(policies.ASSESSMENT_POLICY)})
    rows = rows.withColumns({"label": F.when(k % 4 == 0, "ODD").otherwise(F.col("label")), "policy_version": F.when(k % 9 == 0, "other@1").otherwise(F.col("policy_version"))})
    return metrics.control_errors(rows.unionByName(again)).select("code", "n")


@query(f"""with {_CASES}, input as (select publication_id from lst where p_partkey % 13 <> 0),
  mem13 as (select * from mem where publication_id in (select publication_id from input)),
  b13 as (select rule_pos, total_area, rooms, location_text, count(*) * (count(*) - 1) // 2 pairs from mem13 group by all),
  conf as (select *, case when label <> 'CONFIRMED_RELATIONSHIP' then 'rejected_relationship' when not_assessed then 'pair_not_assessed'
    when left_publication_id not in (select publication_id from input) or right_publication_id not in (select publication_id from input) then 'outside_generation_input' end early,
    case when la = ra and lr = rr then (select any_value(pairs) from b13 where rule_pos = 0 and total_area = la and rooms = lr) end p0,
    case when la = ra and ll = rl then (select any_value(pairs) from b13 where rule_pos = 1 and total_area = la and location_text = ll) end p1 from cases)
  select coalesce(early, case when p0 <= {LIMIT} or p1 <= {LIMIT} then 'covered' when p0 is null and p1 is null then 'no_shared_key' else 'oversized_bucket' end) kind, count(*) n from conf group by 1""")
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each labelled pair under a generation that lacks every thirteenth publication."""
    return _coverage(spark, sf_dir).classes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _coverage(spark: SparkSession, sf_dir: str) -> metrics.Coverage:
    rows = written(part_observations(spark, sf_dir))  # parsed once: cases and generation both need them, several times over
    current = rows.where(F.col("publication_id").cast("long") % 13 != 0)
    return metrics.coverage(control_cases(rows), blocking.generate(current, LIMIT))


ORACLE_SQL["coverage_counts"] = ORACLE_SQL["coverage_classes"].rpartition("select coalesce(early")[0].rstrip() + f""",
  kinds as (select coalesce(early, case when p0 <= {LIMIT} or p1 <= {LIMIT} then 'covered' when p0 is null and p1 is null then 'no_shared_key' else 'oversized_bucket' end) kind from conf)
  select count(*) population, count(*) filter (where kind = 'covered') covered, count(*) filter (where kind in ('covered', 'no_shared_key', 'oversized_bucket')) eligible, count(*) filter (where kind = 'no_shared_key') no_shared_key,
  count(*) filter (where kind = 'oversized_bucket') oversized from kinds"""


@query(ORACLE_SQL["coverage_counts"])
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coverage(spark, sf_dir).rows
    return c.select("population", F.col("coverage.numerator").alias("covered"), F.col("coverage.denominator").alias("eligible"), "no_shared_key", "oversized")


# Conversations as review chains.


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("code"), (F.col("turn") + 1).alias("revision"), F.col("role").alias("reviewer"))


@query("select conv_id code, max(turn) + 1 revision, arg_max(role, turn) reviewer from conversations group by 1")
def review_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chain_heads(_chains(spark, sf_dir))


@query("""select code, revision, expected from (select conv_id code, turn + 1 revision, row_number() over (partition by conv_id order by turn) expected from conversations where turn % 5 <> 3)
  where expected <> revision""")
def review_chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains from which every fifth revision is missing."""
    rows = _chains(spark, sf_dir).where((F.col("revision") - 1) % 5 != 3)
    return review.broken_chains(rows).select("code", "revision", F.col("expected").cast("long").alias("expected"))


# Lookups.


@query("select cast(user_id as varchar) publication_id, ts observed_at, event_type <> 'error' found from events")
def exact_key_lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested keys, found (semi join) or missing (anti join) among available observations."""
    rows = event_observations(spark, sf_dir)
    wanted = table(spark, sf_dir, "events").select(F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("publication_id"), F.col("ts").alias("observed_at"))
    stored = rows.where("is_available").select(*history.KEY)
    found = wanted.join(stored, list(history.KEY), "left_semi").withColumn("found", F.lit(True))
    missing = wanted.join(stored, list(history.KEY), "left_anti").withColumn("found", F.lit(False))
    return found.unionByName(missing).drop("source_id")




# The store.


_KEPT = """
one as (select o_custkey, o_orderdate seen, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) n from orders),
kept as (select o_custkey, seen, case when seen < (select quantile_disc(o_orderdate, 0.5) from orders) then 1 else 2 end revision from one where n = 1)"""


def _stored_orders(spark: SparkSession, sf_dir: str) -> Store:
    """A store with orders as histories, committed in two batches: before and from the median day on."""
    orders = table(spark, sf_dir, "orders")
    cut = orders.agg(F.expr("percentile_disc(0.5) within group (order by unix_micros(o_orderdate :: timestamp))").alias("t"))
    first = F.row_number().over(Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey"))
    status = F.struct(F.struct(F.lit("present").alias("state"), F.col("o_orderstatus").alias("value")).alias("location_text"))
    rows = orders.withColumn("n", first).where("n = 1").join(F.broadcast(cut)).select(
        F.lit("orders").alias("source_id"), F.col("o_custkey").cast("string").alias("publication_id"), F.col("o_orderdate").alias("observed_at"),
        F.lit(True).alias("is_available"), status.alias("listing"), F.lit(None).cast("string").alias("evidence"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) < F.col("t")).alias("early"),
    )
    rows = written(rows)
    store, keep = Store(spark, f"{shared_dir(spark)}/store"), [*history.KEY, *history.CONTENT]
    for code, early in (("first", True), ("second", False)):
        batch = rows.where(F.col("early") == early).select(*keep)
        known = rows.where(F.lit(not early) & F.col("early")).select(*keep)
        touched, heads = batch.select(*history.REF).distinct(), store.heads()
        expected = touched.withColumn("revision", F.lit(None).cast("bigint")) if heads is None else touched.join(heads, list(history.REF), "left")
        store.commit_histories(code, batch, history.append(known, batch, fields=()), expected)
    return store


@query(f"with {_KEPT} select cast(o_custkey as varchar) publication_id, seen observed_at, cast(revision as bigint) revision from kept")
def store_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_orders(spark, sf_dir).observations().select("publication_id", "observed_at", "revision")


@query(f"""with {_KEPT} select cast(c_custkey as varchar) publication_id, cast(max(revision) as bigint) revision, count(seen) observations from customer left join kept on o_custkey = c_custkey group by 1""")
def store_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' histories as the store has them; those of customers without orders are absent."""
    wanted = table(spark, sf_dir, "customer").select(F.lit("orders").alias("source_id"), F.col("c_custkey").cast("string").alias("publication_id"))
    loaded = _stored_orders(spark, sf_dir).load_histories(wanted)
    return loaded.groupBy("publication_id", "revision").agg(F.count("observed_at").alias("observations"))
