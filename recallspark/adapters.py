"""Given tables reshaped into the memory schemas. Every adapter covers its whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import empty_strings
from .operators.extract import entity_id
from .session import written

AS_OF = dt.date(2001, 7, 15)
AS_OF_TIME = dt.datetime(2001, 7, 15, 12, 0, 0)


class Tables:
    """Lazy access to the given tables and the reshaped ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- documents -----------------------------------------------------------
    def docs(self) -> DataFrame:
        """Documents as memory documents; the title is the first line."""
        d = self.read("documents")
        name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
        return d.select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), name.alias("path"),
            F.substring_index("text", "\n", 1).alias("title"), F.lit("note").alias("doc_type"),
            F.date_sub(F.lit(AS_OF), (F.col("doc_id") % 400).cast("int")).alias("date"),
            F.col("text").alias("body"), empty_strings().alias("people"),
            empty_strings().alias("organizations"), F.lit(None).cast("string").alias("project"),
            F.array(F.col("lang")).alias("tags"),
            F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("metadata"),
            F.lit(None).cast("string").alias("area"), "source")

    def order_facts(self) -> DataFrame:
        """Orders with customer, nation and region names. The dimensions are small or left to AQE."""
        nr = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        c = self.read("customer").join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
        o = self.read("orders").withColumn("day", F.to_date("o_orderdate"))
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "day", "c_name", "c_mktsegment",
            "n_nationkey", "n_name", "r_name")

    def notes(self) -> DataFrame:
        """One note per line item: a heading, a marked line by status flags and a follow-up line."""
        li = self.read("lineitem").join(self.order_facts(), F.col("l_orderkey") == F.col("o_orderkey"))
        flag = F.concat("l_returnflag", "l_linestatus")
        mark = (F.when(flag == "RF", "DECISIÓN: ").when(flag == "RO", "Hipótesis: ").when(flag == "AF", "- [ ] ")
                .when(flag == "AO", "PREGUNTA: ").when(flag == "NF", "idea: ").otherwise(""))
        s = lambda c: F.col(c).cast("string")
        text = F.concat(F.lit("pieza "), s("l_partkey"), F.lit(" de proveedor "), s("l_suppkey"),
                        F.lit(" cantidad "), F.col("l_quantity").cast("int").cast("string"))
        follow = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("\n  * [ ] revisar "), s("l_partkey"))).otherwise("")
        body = F.concat(F.lit("# Order "), s("l_orderkey"), F.lit("\n\n"), mark, text, follow)
        key = F.concat_ws("-", F.lit("note"), s("l_orderkey"), s("l_linenumber"), s("l_partkey"), s("l_suppkey"),
                          F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
        return li.select(
            key.alias("id"), F.concat(F.lit("orders/"), F.lower("c_mktsegment"), F.lit("/"), s("l_orderkey"),
                                      F.lit(".md")).alias("path"),
            F.concat(F.lit("Order "), s("l_orderkey")).alias("title"),
            F.when(F.col("l_orderkey") % 3 == 0, "meeting").otherwise("note").alias("doc_type"),
            F.col("day").alias("date"), body.alias("body"), F.array("c_name").alias("people"),
            F.array("r_name").alias("organizations"), F.col("n_name").alias("project"),
            F.array(F.lower("c_mktsegment")).alias("tags"),
            F.create_map(F.lit("source"), F.col("c_mktsegment")).alias("metadata"),
            F.lit(None).cast("string").alias("area"), F.col("c_mktsegment").alias("source"))

    # -- knowledge objects ----------------------------------------------------
    def written(self, name: str) -> DataFrame:
        """A reshaped table written once below the run folder, for jobs that look at it many times."""
        return written(getattr(self, name)(), name)

    def kos(self) -> DataFrame:
        """One object per order; the type follows the key, the status the order status."""
        k = F.col("o_orderkey")
        kinds = F.array(*[F.lit(x) for x in ("decision", "task", "fact", "idea", "question", "hypothesis", "event")])
        kind = F.element_at(kinds, (k % 7 + 1).cast("int"))
        ks = k.cast("string")
        words = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
        return self.order_facts().select(
            F.concat(F.lit("ko-"), ks).alias("id"), kind.alias("ko_type"),
            F.concat(F.lit("Pedido "), ks, F.lit(" "), F.col("c_mktsegment")).alias("title"),
            F.concat(F.lit("Pedido "), ks, F.lit(" de "), F.lower("c_mktsegment"), F.lit(" con prioridad "), words)
            .alias("statement"),
            F.col("day").alias("date"), F.array("c_name").alias("people"), F.col("n_name").alias("project"),
            F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "active")
            .otherwise("archived").alias("status"),
            F.when(k % 7 == 0, "confirmed").otherwise("probable").alias("confidence"),
            F.concat(F.lit("doc-"), F.floor(k / 8).cast("string")).alias("source_doc"),
            F.array(F.lower("c_mktsegment")).alias("tags"), F.col("day").alias("valid_from"),
            F.when(kind == "task", F.date_add("day", (k % 60).cast("int"))).alias("valid_to"),
            F.col("r_name").alias("area"))

    # -- graph ------------------------------------------------------------------
    def entities(self) -> DataFrame:
        people = self.read("customer").select(F.col("c_name").alias("name"), F.lit("person").alias("entity_type"))
        orgs = self.read("supplier").select(F.col("s_name").alias("name"), F.lit("organization").alias("entity_type"))
        projects = self.read("nation").select(F.col("n_name").alias("name"), F.lit("project").alias("entity_type"))
        every = people.unionByName(orgs).unionByName(projects)
        alias = F.when(F.col("entity_type") == "project", F.array(F.concat(F.lit("Plan "), "name"))).otherwise(empty_strings())
        return every.select(entity_id(F.col("name"), F.col("entity_type")).alias("id"), "name", "entity_type",
                            alias.alias("aliases"))

    def edges(self) -> DataFrame:
        """Customer works with supplier (distinct pairs, since the first order) and takes part in a nation."""
        o = self.read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
        pair = (self.read("lineitem").select("l_orderkey", "l_suppkey")
                .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy("o_custkey", "l_suppkey").agg(F.min("day").alias("valid_from"), F.max("day").alias("last")))
        c = self.read("customer").select("c_custkey", "c_name", "c_nationkey")
        s = self.read("supplier").select("s_suppkey", "s_name")
        works = (pair.join(c, F.col("o_custkey") == F.col("c_custkey"))
                 .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
                 .select(entity_id(F.col("c_name"), F.lit("person")).alias("source_id"),
                         entity_id(F.col("s_name"), F.lit("organization")).alias("target_id"),
                         F.lit("works_with").alias("rel_type"), "valid_from",
                         F.when(F.col("last") > F.col("valid_from"), F.col("last")).alias("valid_to")))
        first = o.groupBy("o_custkey").agg(F.min("day").alias("valid_from"))
        joins = (first.join(c, F.col("o_custkey") == F.col("c_custkey"))
                 .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                 .select(entity_id(F.col("c_name"), F.lit("person")).alias("source_id"),
                         entity_id(F.col("n_name"), F.lit("project")).alias("target_id"),
                         F.lit("participates_in").alias("rel_type"), "valid_from",
                         F.lit(None).cast("date").alias("valid_to")))
        both = works.unionByName(joins)
        return both.select(F.concat_ws(">", "source_id", "rel_type", "target_id").alias("id"), "source_id",
                           "target_id", "rel_type", "valid_from", "valid_to", F.lit("probable").alias("confidence"),
                           F.lit(None).cast("string").alias("source_doc"))

    # -- mail ---------------------------------------------------------------------
    def mail(self) -> DataFrame:
        o = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        address = F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit("no-reply@c"), c, F.lit(".example.com"))).otherwise(
            F.concat("c_name", F.lit(" <c"), c, F.lit("@example.com>")))
        snippet = (F.when(F.col("o_orderstatus") == "O", "favor confirmar la entrega")
                   .when(F.col("o_orderstatus") == "P", "newsletter semanal").otherwise("entrega cerrada"))
        return o.select(
            F.concat(F.lit("m-"), k.cast("string")).alias("id"), F.lit("acct").alias("account"), address.alias("from"),
            F.lit("me@example.com").alias("to"),
            F.concat("o_orderpriority", F.lit(" order "), k.cast("string")).alias("subject"),
            F.col("o_orderdate").cast("timestamp").alias("date"), snippet.alias("snippet"),
            F.when(k % 5 == 0, F.array(F.lit("INBOX"), F.lit("CATEGORY_PROMOTIONS")))
            .otherwise(F.array(F.lit("INBOX"))).alias("labels"),
            F.concat(F.lit("cuerpo del pedido "), k.cast("string")).alias("body"))

    def pinned(self) -> DataFrame:
        """Pinned people: the best customers by balance of every nation."""
        c = self.read("customer").groupBy("c_nationkey").agg(F.max_by("c_name", F.struct("c_acctbal", "c_name")).alias("name"))
        return c.select("name", F.lit(True).alias("pin"), F.concat(F.lit("rol "), F.col("c_nationkey").cast("string")).alias("role"))

    # -- dimensions -----------------------------------------------------------------
    def areas(self) -> DataFrame:
        nations = self.read("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("projects"))
        return (self.read("region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
                .select(F.col("r_regionkey").alias("map_order"), F.col("r_name").alias("id"),
                        F.concat(F.lit("Área "), "r_name").alias("name"),
                        F.split(F.col("r_name"), " ").alias("keywords"), empty_strings().alias("people"), "projects"))

    def overrides(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.read("region").select(
            F.col("r_name").alias("area"), F.when(k == 2, 2.0).otherwise(1.0).alias("weight"),
            F.when(k == 0, 1).alias("pin"), F.when(k == 4, "pausada").otherwise("activa").alias("status"))

    def projects(self) -> DataFrame:
        n = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        k = F.col("n_nationkey")
        ms = lambda i, shift: F.struct(F.concat(F.lit(f"Hito {i} "), "n_name").alias("name"),
                                       F.date_add(F.lit(AS_OF), k + shift).cast("string").alias("due"))
        return n.select(F.lower("n_name").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("area"),
                        F.date_add(F.lit(AS_OF), k + 60).cast("string").alias("deadline"),
                        F.lit(None).cast("string").alias("start"), F.array(ms(1, -5), ms(2, 9)).alias("milestones"),
                        empty_strings().alias("people"), F.array(F.upper("n_name")).alias("keywords"))

    # -- questions ------------------------------------------------------------------
    def questions(self) -> DataFrame:
        """One question per (nation, segment), phrased for one of the six intents."""
        f = self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        g = f.groupBy("n_nationkey", "n_name", "c_mktsegment").agg(F.min("c_name").alias("who"))
        seg, kind = F.lower("c_mktsegment"), F.col("n_nationkey") % 6
        text = (F.when(kind == 0, F.concat(F.lit("¿Qué decidimos sobre "), seg, F.lit("?")))
                .when(kind == 1, F.concat(F.lit("¿Quién trabaja con "), "who", F.lit("?")))
                .when(kind == 2, F.concat(F.lit("¿Qué tareas pendientes tengo con "), "n_name", F.lit(" de "), seg, F.lit("?")))
                .when(kind == 3, F.concat(F.lit("¿Cuándo fue la última entrega de "), seg, F.lit("?")))
                .when(kind == 4, F.concat(F.lit("¿Qué debería discutir con "), "who", F.lit("?")))
                .otherwise(F.concat(F.lit("resumen "), seg, F.lit(" urgente pedido"))))
        return g.select(F.concat_ws("|", "n_name", "c_mktsegment").alias("query_id"), text.alias("text"),
                        F.col("c_mktsegment").alias("segment"), "n_name")

    def bench_queries(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")

    # -- vectors --------------------------------------------------------------------
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("id"), "label",
            F.col("embedding").cast("array<double>").alias("embedding"))

    # -- conversations ----------------------------------------------------------------
    def chat_lines(self) -> DataFrame:
        """Events as lines of an exported chat, numbered by event."""
        e = self.read("events")
        line = F.concat(F.date_format("ts", "dd/MM/yy, HH:mm"), F.lit(" - User"), F.col("user_id").cast("string"),
                        F.lit(": "), F.col("event_type"), F.lit(" "), F.col("value").cast("decimal(12,2)").cast("string"))
        return e.select(F.concat(F.lit("chat"), (F.col("user_id") % 3).cast("string")).alias("chat"),
                        F.col("event_id").alias("seq"), line.alias("line"))

    def transcript_lines(self) -> DataFrame:
        """Every text line of every turn; the first line of a turn names the speaker."""
        c = self.read("conversations")
        lines = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("n", "line"))
        named = F.concat(F.initcap("role"), F.lit(": "), F.col("line"))
        return lines.select(F.col("conv_id").cast("string").alias("id"),
                            (F.col("turn") * 1_000_000 + F.col("n")).alias("line_no"),
                            F.when(F.col("n") == 0, named).otherwise(F.col("line")).alias("line"))

    # -- folders ------------------------------------------------------------------------
    def files(self) -> DataFrame:
        k = F.col("doc_id")
        ext = F.element_at(F.array(F.lit(".md"), F.lit(".pdf"), F.lit(".jpg"), F.lit(".exe")), (k % 4 + 1).cast("int"))
        return self.read("documents").select(
            F.lit("/home/Documents").alias("root"), F.col("source").alias("folder"), F.lit("").alias("subpath"),
            F.concat(F.col("lang"), F.lit("-"), k.cast("string"), F.when(k % 40 == 0, "-asia").otherwise(""), ext).alias("name"),
            F.col("n_chars").alias("size"),
            F.date_sub(F.lit(AS_OF), (k % 200).cast("int")).cast("timestamp").alias("mtime"))

    # -- references -----------------------------------------------------------------------
    def biblio(self) -> DataFrame:
        """One small bibliography per part: a numbered entry and a loose DOI in the text."""
        k = F.col("p_partkey")
        ks = k.cast("string")
        year = (F.lit(1990) + F.col("p_size") % 30).cast("string")
        doi = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" doi 10.1000/p"), ks, F.lit(".")))
        entry = F.concat(F.lit("1. "), F.initcap(F.substring_index("p_name", " ", 1)), F.lit(" K, et al. Estudio de "),
                         F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" numero "), ks,
                         F.lit(". Revista. "), year, F.lit(";"), doi)
        loose = F.concat(F.lit("\nVer tambien https://doi.org/10.2000/L"), (k % 50).cast("string"), F.lit(", y 10.1000/P"), ks)
        return self.read("part").select(F.concat(F.lit("bib-"), ks).alias("id"),
                                        F.concat(F.lit("# Bibliografía\n"), entry, loose).alias("body"))

    def works(self) -> DataFrame:
        """Registered works; every ninth has another year and every eleventh another DOI."""
        k = F.col("p_partkey")
        ks = k.cast("string")
        year = F.lit(1990) + F.col("p_size") % 30 + F.when(k % 9 == 0, 1).otherwise(0)
        title = F.concat(F.lit("Estudio de "), F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" número "), ks)
        return self.read("part").select(
            F.concat(F.when(k % 11 == 0, "10.3000/X").otherwise("10.1000/P"), ks).alias("doi"), title.alias("title"),
            F.initcap(F.substring_index("p_name", " ", 1)).alias("family"), year.cast("string").alias("year"))

    # -- plans --------------------------------------------------------------------------------
    def plan_sheets(self) -> DataFrame:
        """Spreadsheet rows as cells: a title row, a header row, then one row per line item."""
        li = self.read("lineitem")
        s = lambda c: F.col(c).cast("string")
        row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint") + 10
        cells = F.array(F.lit("F1"), F.concat(F.lit("S"), s("l_linenumber")), F.concat(F.lit("Pieza "), s("l_partkey")),
                        F.when(F.col("l_linestatus") == "F", "IP"), F.concat(F.lit("Informe "), s("l_suppkey")),
                        F.when(F.col("l_linestatus") == "F", "Completado").otherwise("Pendiente"), F.lit("Alta"))
        rows = li.select(F.concat(F.lit("plan-"), s("l_returnflag")).alias("file"), s("l_linestatus").alias("sheet"),
                         row.alias("row"), cells.alias("cells"))
        keys = li.select(F.concat(F.lit("plan-"), s("l_returnflag")).alias("file"), s("l_linestatus").alias("sheet")).distinct()
        head = F.array(*[F.lit(x) for x in ("Fase", "Sem.", "Actividad", "Responsable", "Entregable", "Estado", "Prioridad")])
        title = keys.select("file", "sheet", F.lit(1).cast("bigint").alias("row"), F.array(F.lit("PLAN DE TRABAJO")).alias("cells"))
        header = keys.select("file", "sheet", F.lit(2).cast("bigint").alias("row"), head.alias("cells"))
        return title.unionByName(header).unionByName(rows)
