"""Case tables rendered from the star-schema test tables, in SQL that Spark and DuckDB both run.

``{table}`` stands for a table. ``load`` gives a view as a DataFrame over Parquet; ``with_views``
puts the same views before a DuckDB query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.tables import save

_FIRST = "Harbor,Ridge,Apex,Metro,Civic,Union,Summit,Delta,Grand,Pioneer"
_SECOND = "Council,Authority,Trust,Holdings,Department,Alliance,Foundation,Bank,Group,Partners"
_GIVEN = "Alex,Robin,Casey,Morgan,Jamie,Taylor,Jordan,Drew,Quinn,Sasha"
_FAMILY = "Hartley,Okafor,Lindqvist,Marsh,Delgado,Whitfield,Petrov,Nakamura,Osei,Brandt"


def _at(words: str, k: str) -> str:
    return f"split_part('{words}', ',', cast({k} % {words.count(',') + 1} as int) + 1)"


def _name(k: str) -> str:
    """The k-th of 100 names: every fourth a person, else an organization."""
    tens = f"cast(floor({k} / 10) as bigint)"
    return f"case when {k} % 4 = 3 then concat({_at(_GIVEN, k)}, ' ', {_at(_FAMILY, tens)}) else concat({_at(_FIRST, k)}, ' ', {_at(_SECOND, tens)}) end"


_TYPE = "case when {k} % 4 = 3 then 'person' when cast(floor({k} / 10) as bigint) % 10 in (0, 1, 4) then 'agency' else 'organization' end"

VIEWS = {
    # one row for each order and line number
    "lines": """
        select l_orderkey as o, l_linenumber as n, max(l_partkey) as p, max(l_suppkey) as s, cast(max(l_quantity) as bigint) as q,
               cast(round(max(l_discount) * 100) as bigint) as d, cast(round(max(l_extendedprice)) as bigint) as price
        from {lineitem} group by l_orderkey, l_linenumber""",
    "mentions": f"""
        select o * 8 + n as id, o as document_id, o % 50 as case_id, {_name("((s * 7 + p) % 100)")} as entity_name,
               {_TYPE.format(k="((s * 7 + p) % 100)")} as entity_type, cast(45 + 5 * d as double) / 100 as confidence,
               case (o + n) % 4 when 0 then 'approved' when 1 then 'rejected' else 'pending' end as status,
               {_at("GOVERNMENT_AGENCY,OFFICIAL,CONTRACTOR,UNKNOWN,COMMITTEE,PERSON,UNKNOWN", "(p + n)")} as role,
               {_at("HIGH,MEDIUM,LOW,OFF_TOPIC,LOW", "q")} as topic, {_at("title,dek,lead,body,body,tail,sidebar,footer", "(p + q)")} as zone
        from {{lines}}""",
    "entities": f"""
        select case_id * 100 + k as id, case_id, {_name("k")} as name, {_TYPE.format(k="k")} as type
        from (select o % 50 as case_id, (s * 7 + p) % 100 as k from {{lines}} group by o % 50, (s * 7 + p) % 100 having count(distinct o) >= 2)""",
    "relationships": """
        select min(id) as id, case_id, a * 1 + 0 as entity_a_id, b as entity_b_id, min(kind) as relationship_type, cast(max(c) as double) / 100 as confidence
        from (select o * 8 + n as id, o % 50 as case_id, (o % 50) * 100 + (s * 7 + p) % 100 as a, (o % 50) * 100 + (p * 3 + q) % 100 as b,
                     split_part('co_mention,repeated_association,title_co_mention,ad,provisional_co_mention', ',', cast(q % 5 as int) + 1) as kind, 20 + q as c from {lines})
        where a < b group by case_id, a, b""",
    "evidence": "select o * 8 + n as id, (o * 8 + n) - (q % 3) as relationship_id, o as document_id from {lines} where d > 3",
    "signals": f"""
        select o * 8 + n as id, o as document_id, o % 50 as case_id, concat('Order ', cast(o as string)) as document_title,
               case when q % 9 = 0 then 'NON-NUMERIC' else concat('$', cast(price * 100 as string)) end as amount_display,
               case when q % 9 = 0 then cast(null as double) else cast(price * 100 as double) end as normalized_amount,
               case when q % 9 = 0 then 'NON_NUMERIC_FUNDING' else {_at("CONTRACT,GRANT,AUDIT,COST_OVERRUN,FUNDING,ALLOCATION", "(p + n)")} end as signal_type,
               case when p % 5 = 0 then cast(null as string) else {_name("((s * 7 + p) % 100)")} end as entity_name,
               case when q % 3 = 0 then cast(null as string) else {_name("((s * 3) % 100)")} end as controlled_by,
               case when q % 4 = 0 then cast(null as string) else {_name("((p * 3) % 100)")} end as received_by,
               case when p % 3 = 0 then concat({_at(_FIRST, "p")}, ' Housing Program') end as program_name,
               case when p % 2 = 0 then concat('Funds of ', cast(price * 100 as string), ' dollars went out under a no-bid award this year') else 'Short note' end as event_summary,
               cast(30 + 7 * d as double) / 100 as financial_confidence, case when p % 6 = 0 then cast(null as boolean) else p % 4 = 0 end as inferred_signal
        from {{lines}}""",
    "timeline": f"""
        select o_orderkey as id, o_orderkey % 50 as case_id, o_orderkey as document_id, cast(o_orderdate as date) as event_date,
               {_at("CONTRACT,AUDIT,LAWSUIT,APPROVAL,FUNDING,EVENT,HEARING,ARREST", "o_custkey")} as event_type,
               concat(lower({_name("(o_custkey % 100)")}), ' acted on order ', cast(o_custkey as string)) as title, o_orderkey % 11 = 0 as soft_event
        from {{orders}}""",
    "files": """
        select o_orderkey as id, o_orderkey % 50 as case_id, concat('Order ', cast(o_orderkey as string)) as title,
               case when o_orderkey % 13 = 0 then cast(null as date) else cast(o_orderdate as date) end as publish_date,
               split_part('county.gov,example.com,prnewswire.com,apnews.com,blog.example.org', ',', cast(o_custkey % 5 as int) + 1) as source_domain,
               concat(case when o_orderkey % 17 = 0 then '' else concat('[DIAG:status=', split_part('valid,partial,failed,wrapper,valid', ',', cast(o_custkey % 5 as int) + 1),
                      '|score=', cast(o_custkey % 60 as string), '|priority=', split_part('PRIORITY_A,PRIORITY_B,LOW_SIGNAL', ',', cast(o_orderkey % 3 as int) + 1),
                      '|alignment=', split_part('matched,partial,none', ',', cast(o_custkey % 3 as int) + 1), '|chars=', cast(o_custkey * 37 % 9000 as string),
                      '|entities=', cast(o_orderkey % 8 as string), '] ') end, repeat('Body of the order text. ', cast(o_custkey % 9 as int))) as raw_text
        from {orders}""",
    "cases": "select distinct o_orderkey % 50 as id, concat('Case ', cast(o_orderkey % 50 as string)) as title, case when o_orderkey % 50 % 3 = 0 then 'closed' else 'open' end as status from {orders}",
    "log": "select event_id as id, case event_type when 'error' then case when event_id % 2 = 0 then 'seed_no_promotion' else 'extraction_failed' end when 'purchase' then 'graph_built' when 'signup' then 'auth_login' when 'click' then 'query_run' when 'view' then 'document_ingested' else event_type end as event_type, user_id as case_id, ts as created_at from {events}",
    # sentences as they come in reports, several to a document
    "sentences": f"""
        select o as document_id, n as pos, concat(
                 case n when 1 then concat({_name("((s * 3) % 100)")}, ' awarded $', cast(1 + price % 90 as string), '.', cast(q % 10 as string), ' million to ', {_name("((p * 3) % 100)")}, ' for the {{{{p}}}} in ')
                        when 2 then concat('The audit by ', {_name("((s * 3) % 100)")}, ' found $', cast(1 + price % 900 as string), ',', cast(100 + p % 900 as string), ' missing from the grant in ')
                        when 3 then concat('A lawsuit against ', {_name("((p * 3) % 100)")}, ' was filed on ')
                        else concat('The council approved a budget of USD ', cast(10000 + price as string), ' for ', {_name("((p * 3) % 100)")}, ' by ') end,
                 split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', cast(p % 12 as int) + 1), ' ',
                 case when q % 2 = 0 then concat(cast(1 + q % 28 as string), ', ') else '' end, cast(1998 + q % 20 as string), '.') as sentence
        from {{lines}}""".replace("{{p}}", "Harbor Renewal Program"),
}

_TABLE = re.compile(r"\{([a-z]\w*)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where no view has the name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = set(_TABLE.findall(VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: load(spark, sf_dir, t) for t in needs})


def _needs(name: str) -> set[str]:
    own = set(_TABLE.findall(VIEWS.get(name, "")))
    return own.union(*map(_needs, own)) if own else own


def load_all(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Several views; the lines that two or more of them are rendered from are grouped and written once."""
    few = sum("lines" in _needs(n) for n in names) < 2
    ready = {} if few else {"lines": save(load(spark, sf_dir, "lines"))}

    def render(name: str) -> DataFrame:
        if name not in VIEWS:
            return load(spark, sf_dir, name)
        if name not in ready:
            ready[name] = spark.sql(VIEWS[name], **{t: render(t) for t in set(_TABLE.findall(VIEWS[name]))})
        return ready[name]

    return [render(n) for n in names]


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text, csv and Markdown files below a folder as documents (path, title, extension, raw_text), each file whole."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw_text"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", F.try_url_decode(F.regexp_replace(name, r"\.[^.]*$", "")).alias("title"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), "raw_text")


def of_case(tables: DataFrame, case_id: int, n_buckets: int | None = None) -> DataFrame:
    """The rows of one case; where tables are partitioned by case_bucket, only its bucket is read."""
    own = tables.filter(F.col("case_id") == case_id)
    return own if n_buckets is None else own.filter(F.col("case_bucket") == F.pmod(F.hash(F.lit(case_id).cast("long")), F.lit(n_buckets)))


def bucketed(tables: DataFrame, n_buckets: int) -> DataFrame:
    """tables with case_bucket, to partition a written table by."""
    return tables.withColumn("case_bucket", F.pmod(F.hash(F.col("case_id").cast("long")), F.lit(n_buckets)))


def with_views(sql: str) -> str:
    """A DuckDB query over ``{view}`` names, with the views that it needs before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for t in _TABLE.findall(text):
            if t in VIEWS and t not in order:
                need(VIEWS[t])
                order.append(t)

    need(sql)
    plain = lambda s: _TABLE.sub(lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], s)
    views = [f"v_{t} as materialized ({plain(VIEWS[t])})" for t in order]
    if not views:
        return plain(sql)
    if sql.lstrip().lower().startswith("with "):
        own = sql.lstrip()[5:].lstrip()
        recursive = own.lower().startswith("recursive ")
        return f"with {'recursive ' if recursive else ''}{', '.join(views)}, {plain(own[10:] if recursive else own)}"
    return f"with {', '.join(views)} {plain(sql)}"
