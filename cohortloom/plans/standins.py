"""The benchmark tables seen as the library's inputs.

Each stand-in exists twice, as a DataFrame and as the SQL that gives the same
rows, so that every query can be checked against an independent answer.
Missing values are injected by a fixed arithmetic rule on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import clean_number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- sparse long matrix: orders as samples, parts as probes ------------------

def order_matrix(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    gap = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 11 == 0
    return li.select(F.col("l_orderkey").alias("sample_id"),
                     F.col("l_partkey").alias("probe_id"),
                     F.when(~gap, F.col("l_extendedprice")).alias("m_value"))


ORDER_MATRIX = """
  SELECT l_orderkey AS sample_id, l_partkey AS probe_id,
         CASE WHEN (l_orderkey * 7 + l_partkey) % 11 = 0 THEN NULL
              ELSE l_extendedprice END AS m_value
  FROM lineitem"""


def part_meta(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("probe_id"),
        F.when(~F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_brand"))
         .alias("gencodebasic_name"),
        F.when(F.col("p_type") == "PROMO", "chrX").when(F.col("p_type") == "SMALL", "chrM")
         .otherwise("chr1").alias("chr_hg38"))


PART_META = """
  SELECT p_partkey AS probe_id,
         CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN NULL ELSE p_brand END
           AS gencodebasic_name,
         CASE p_type WHEN 'PROMO' THEN 'chrX' WHEN 'SMALL' THEN 'chrM' ELSE 'chr1' END
           AS chr_hg38
  FROM part"""


def part_blacklist(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    reasons = F.array_compact(F.array(
        F.when(F.col("p_size") <= 5, "Polymorphism"),
        F.when(F.col("p_size").between(4, 9), "CrossHybridization")))
    return p.select(F.col("p_partkey").alias("probe_id"), F.explode(reasons).alias("reason"))


PART_BLACKLIST = """
  SELECT p_partkey AS probe_id, 'Polymorphism' AS reason FROM part WHERE p_size <= 5
  UNION ALL
  SELECT p_partkey, 'CrossHybridization' FROM part WHERE p_size BETWEEN 4 AND 9"""


# -- dense long matrix: vectors as samples, dimensions as probes -------------

def vector_matrix(spark, sf_dir, gaps: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    long = e.select(F.col("vec_id").alias("sample_id"),
                    F.posexplode("embedding").alias("pos", "v"))
    probe = F.concat(F.lit("d"), F.col("pos").cast("string")).alias("probe_id")
    if not gaps:
        return long.select("sample_id", probe, F.col("v").cast("double").alias("m_value"))
    hit = (F.col("pos") % 3 == 0) & ((F.col("sample_id") * 7 + F.col("pos")) % 97 == 0)
    raw = F.when(hit & (F.col("sample_id") % 2 == 0), F.lit("Infinity")).when(
        hit, F.lit("NaN")).otherwise(F.col("v").cast("double").cast("string"))
    return long.select("sample_id", probe, clean_number(raw).alias("m_value"))


VECTOR_FULL = """
  SELECT vec_id AS sample_id, 'd' || CAST(pos AS VARCHAR) AS probe_id,
         CAST(v AS DOUBLE) AS m_value, pos
  FROM (SELECT vec_id, unnest(embedding) AS v,
               generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""

VECTOR_MATRIX = f"""
  SELECT sample_id, probe_id,
         CASE WHEN pos % 3 = 0 AND (sample_id * 7 + pos) % 97 = 0 THEN NULL
              ELSE m_value END AS m_value
  FROM ({VECTOR_FULL})"""


# -- probe manifest: parts in loci of mixed size -----------------------------

def part_manifest(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    # Keys 0-6 of each dozen share one locus, 7-9 the next, 10 stands alone, 11 has none.
    slot = key % 12
    locus = (F.when(slot < 5, F.concat(F.lit("L"), F.floor(key / 12).cast("string"), F.lit("a")))
             .when(slot < 7, F.concat(F.lit("L"), F.floor(key / 12).cast("string"), F.lit("b")))
             .when(slot < 10, F.concat(F.lit("L"), F.floor(key / 12).cast("string"), F.lit("c")))
             .when(slot < 11, F.concat(F.lit("L"), F.floor(key / 12).cast("string"), F.lit("d"))))
    label = (F.when(F.col("p_size") <= 6, "Superior probe")
             .when(F.col("p_size") <= 14, "Best precision by group mean")
             .when(F.col("p_size") <= 18, "Best sensitivity by WGBS")
             .when(F.col("p_size") <= 40, "Inferior precision by group mean"))
    return p.select(key.cast("string").alias("IlmnID"), F.col("p_name").alias("Name"),
                    locus.alias("EPICv1locmatch"), label.alias("Rep_results_by_NAME"))


_LOCUS = """CASE WHEN {k} % 12 < 5 THEN 'L' || CAST({k} // 12 AS VARCHAR) || 'a'
              WHEN {k} % 12 < 7 THEN 'L' || CAST({k} // 12 AS VARCHAR) || 'b'
              WHEN {k} % 12 < 10 THEN 'L' || CAST({k} // 12 AS VARCHAR) || 'c'
              WHEN {k} % 12 < 11 THEN 'L' || CAST({k} // 12 AS VARCHAR) || 'd' END"""

PART_MANIFEST = f"""
  SELECT CAST(p_partkey AS VARCHAR) AS "IlmnID",
         {_LOCUS.format(k='p_partkey')} AS "EPICv1locmatch",
         CASE WHEN p_size <= 6 THEN 'Superior probe'
              WHEN p_size <= 14 THEN 'Best precision by group mean'
              WHEN p_size <= 18 THEN 'Best sensitivity by WGBS'
              WHEN p_size <= 40 THEN 'Inferior precision by group mean' END
           AS "Rep_results_by_NAME"
  FROM part"""


def raw_arrays(spark, sf_dir, source: DataFrame | None = None) -> DataFrame:
    """Raw newer-array rows: lineitem as (sample, probe, locus, two measures).

    Twelve parts share a sample often enough once orders are taken by the dozen.
    """
    li = table(spark, sf_dir, "lineitem") if source is None else source
    key = F.col("l_partkey")
    number = F.floor(key / 12).cast("string")
    slot = key % 12
    locus = F.when(slot < 11, F.concat(
        F.lit("L"), number,
        F.when(slot < 5, "a").when(slot < 7, "b").when(slot < 10, "c").otherwise("d")))
    gap = (F.col("l_orderkey") * 7 + key) % 11 == 0
    return li.select(
        F.floor(F.col("l_orderkey") / 500).alias("sample_id"),
        key.cast("string").alias("Name"), locus.alias("EPICv1_Loci"),
        F.when(~gap, F.col("l_extendedprice")).alias("MValue"),
        F.col("l_discount").alias("Beta"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))


RAW_ARRAYS = f"""
  SELECT l_orderkey // 500 AS sample_id, CAST(l_partkey AS VARCHAR) AS "Name",
         {_LOCUS.format(k='l_partkey')} AS "EPICv1_Loci",
         CASE WHEN (l_orderkey * 7 + l_partkey) % 11 = 0 THEN NULL
              ELSE l_extendedprice END AS "MValue",
         l_discount AS "Beta", l_orderkey * 10 + l_linenumber AS line_no
  FROM lineitem"""

PROBE_MAP = f"""
  SELECT "EPICv1locmatch", "IlmnID" FROM (
    SELECT *, min(rnk) OVER (PARTITION BY "EPICv1locmatch") AS best FROM (
      SELECT *, count(*) OVER (PARTITION BY "EPICv1locmatch") AS n,
             CASE WHEN "Rep_results_by_NAME" = 'Superior probe' THEN 1
                  WHEN "Rep_results_by_NAME" LIKE '%Best%' THEN 2 END AS rnk
      FROM ({PART_MANIFEST}) WHERE "EPICv1locmatch" IS NOT NULL)
    WHERE n IN (2, 3, 4, 5, 6, 10))
  WHERE rnk = best"""


# -- disease tree: region and nation above customers -------------------------

ROOT = "ALL"


def place_edges(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    top = r.select(F.lit(ROOT).alias("parent"), F.col("r_name").alias("child"),
                   F.col("r_regionkey").alias("position"))
    low = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("child"),
        F.col("n_nationkey").alias("position"))
    # An arm without any sample, to be pruned.
    bare = n.select(F.col("n_name").alias("parent"),
                    F.concat(F.col("n_name"), F.lit("_EMPTY")).alias("child"),
                    F.lit(0).alias("position"))
    return top.unionByName(low).unionByName(bare)


PLACE_EDGES = f"""
  SELECT '{ROOT}' AS parent, r_name AS child, r_regionkey AS position FROM region
  UNION ALL
  SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT n_name, n_name || '_EMPTY', 0 FROM nation"""


def place_samples(spark, sf_dir) -> DataFrame:
    """Customers on their nation; those of the MACHINERY segment on its region."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(
        r, n.n_regionkey == r.r_regionkey).select(
        F.when(F.col("c_mktsegment") == "MACHINERY", F.col("r_name"))
         .otherwise(F.col("n_name")).alias("disease_name"),
        F.col("c_custkey").alias("sample_id"))


PLACE_SAMPLES = """
  SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN r_name ELSE n_name END AS disease_name,
         c_custkey AS sample_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""

# The tree of the two tables above, built independently by recursion.
PLACE_NODES = f"""
  walk(node_id, name, parent_id, level, sort_key) AS (
    SELECT '{ROOT}', '{ROOT}', CAST(NULL AS VARCHAR), 1, CAST([] AS VARCHAR[])
    UNION ALL
    SELECT w.node_id || '/' || e.child, e.child, w.node_id, w.level + 1,
           list_append(w.sort_key, lpad(CAST(CAST(e.position AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') || ':' || e.child)
    FROM walk w JOIN ({PLACE_EDGES}) e ON e.parent = w.name),
  ups AS (
    SELECT a.node_id AS ancestor_id, d.node_id AS descendant_id, d.level - a.level AS distance
    FROM walk a JOIN walk d
      ON d.node_id = a.node_id OR starts_with(d.node_id, a.node_id || '/')),
  held AS (
    SELECT node_id, sample_id FROM walk JOIN ({PLACE_SAMPLES}) ON disease_name = name),
  nodes AS (
    SELECT * FROM walk WHERE parent_id IS NULL OR node_id IN (
      SELECT ancestor_id FROM ups JOIN held ON held.node_id = descendant_id))"""


# -- class tree: root, label % 3, label; samples are the vectors --------------

CLASS_ROOT = "R"


def class_edges(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    group = F.concat(F.lit("G"), (F.col("label") % 3).cast("string"))
    top = labels.select(F.lit(CLASS_ROOT).alias("parent"), group.alias("child"),
                        (F.col("label") % 3).alias("position")).distinct()
    low = labels.select(group.alias("parent"),
                        F.concat(F.lit("C"), F.col("label").cast("string")).alias("child"),
                        F.col("label").alias("position"))
    return top.unionByName(low)


def class_samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("C"), F.col("label").cast("string")).alias("disease_name"),
        F.col("vec_id").alias("sample_id"))


# -- clinical tables ----------------------------------------------------------

def clinical(spark, sf_dir) -> dict[str, DataFrame]:
    """Orders as analysis sets, their line items as biosamples, customers as patients."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    bio = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # One row per biosample id; the line items hold a few ids twice.
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    xref = lines.select(bio.alias("biosample_id"), F.col("l_orderkey").alias("analysis_set_id"))
    kind = F.when(F.col("flag") == "A", "wgs").when(F.col("flag") == "N", "methylation") \
        .otherwise("rnaseq")
    biosample = lines.select(
        bio.alias("biosample_id"), F.col("l_orderkey").alias("patient_id"),
        F.col("l_orderkey").alias("public_subject_id"), kind.alias("sample_type"),
        F.when(F.col("status") == "F", "tumour").otherwise("germline").alias("biosample_status"),
        F.when(F.col("l_linenumber") <= 5, "dna").otherwise("rna").alias("biosample_type"))
    analysis_set = o.select(F.col("o_orderkey").alias("analysis_set_id"),
                            F.col("o_custkey").alias("patient_id"))
    purity = o.select(F.col("o_orderkey").alias("purity_id"),
                      F.col("o_orderkey").alias("analysis_set_id"),
                      ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 100 / 100)
                      .alias("purity"))
    return {"xref": xref, "biosample": biosample, "analysis_set": analysis_set,
            "purity": purity}


CLINICAL = """
  lines AS (
    SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS status
    FROM lineitem GROUP BY 1, 2),
  xref AS (
    SELECT l_orderkey * 10 + l_linenumber AS biosample_id, l_orderkey AS analysis_set_id
    FROM lines),
  biosample AS (
    SELECT l_orderkey * 10 + l_linenumber AS biosample_id, l_orderkey AS patient_id,
           CASE flag WHEN 'A' THEN 'wgs' WHEN 'N' THEN 'methylation' ELSE 'rnaseq' END
             AS sample_type,
           CASE status WHEN 'F' THEN 'tumour' ELSE 'germline' END AS biosample_status,
           CASE WHEN l_linenumber <= 5 THEN 'dna' ELSE 'rna' END AS biosample_type
    FROM lines),
  analysis_set AS (SELECT o_orderkey AS analysis_set_id, o_custkey AS patient_id FROM orders),
  purity AS (
    SELECT o_orderkey AS purity_id, o_orderkey AS analysis_set_id,
           ((o_orderkey * 37 + o_custkey) % 100) / 100 AS purity FROM orders)"""


# -- classified samples: orders by priority, with an arithmetic prediction ----

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def calls(spark, sf_dir) -> DataFrame:
    """(sample_id, actual, predicted): orders, right about three times in four."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    other = F.element_at(names, ((F.col("o_orderkey") + F.col("o_custkey")) % 5 + 1).cast("int"))
    wrong = (F.col("o_orderkey") * 13 + F.col("o_custkey")) % 4 == 0
    return o.select(F.col("o_orderkey").alias("sample_id"),
                    F.col("o_orderpriority").alias("actual"),
                    F.when(wrong, other).otherwise(F.col("o_orderpriority")).alias("predicted"))


_NAMES = "[" + ", ".join(f"'{p}'" for p in PRIORITIES) + "]"

CALLS = f"""
  SELECT o_orderkey AS sample_id, o_orderpriority AS actual,
         CASE WHEN (o_orderkey * 13 + o_custkey) % 4 = 0
              THEN {_NAMES}[(o_orderkey + o_custkey) % 5 + 1]
              ELSE o_orderpriority END AS predicted
  FROM orders"""


def class_scores(spark, sf_dir) -> DataFrame:
    """(sample_id, class, actual, score): every class's score of every order."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    long = o.select(F.col("o_orderkey").alias("sample_id"), "o_custkey",
                    F.col("o_orderpriority").alias("actual"),
                    F.posexplode(names).alias("i", "class"))
    noise = (F.col("sample_id") * 31 + F.col("i") * 17 + F.col("o_custkey")) % 997
    bonus = F.when(F.col("actual") == F.col("class"), 300).otherwise(0)
    return long.select("sample_id", "class", "actual", ((noise + bonus) / 1297.0).alias("score"))


CLASS_SCORES = f"""
  SELECT o_orderkey AS sample_id, class, o_orderpriority AS actual,
         ((o_orderkey * 31 + i * 17 + o_custkey) % 997
          + CASE WHEN class = o_orderpriority THEN 300 ELSE 0 END) / 1297.0::DOUBLE AS score
  FROM orders, (SELECT unnest({_NAMES}) AS class,
                       unnest([0, 1, 2, 3, 4]) AS i)"""


def spread(key: str = "sample_id"):
    """An arithmetic shuffling number in [0, 1) that SQL can repeat."""
    return F.pmod(F.col(key) * 2654435761, F.lit(1 << 32)) / float(1 << 32)


SPREAD = "((sample_id * 2654435761) % 4294967296)"

# Labels of the class tree, node by node.
CLASS_DESIGN = """
  SELECT 'R' AS node_id, vec_id AS sample_id, 'G' || CAST(label % 3 AS VARCHAR) AS cancer_type
  FROM embeddings
  UNION ALL
  SELECT 'R/G' || CAST(label % 3 AS VARCHAR), vec_id, 'C' || CAST(label AS VARCHAR)
  FROM embeddings"""


def certainties(spark, sf_dir) -> DataFrame:
    """(actual, predicted, probability) of orders."""
    p = ((F.col("sample_id") * 7919) % 1000 + 1) / 1000.0
    return calls(spark, sf_dir).withColumn("probability", p)


def scored_labels(spark, sf_dir) -> DataFrame:
    """(split, label, probability): document quality against an arithmetic score."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    p = ((F.col("doc_id") * 37 + F.col("n_chars")) % 101 / 202.0
         + F.col("quality") * 0.25 + 0.125)
    return lab.join(docs.select("doc_id", "n_chars"), "doc_id").select(
        F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.col("quality").alias("label"), p.alias("probability"))


SCORED_LABELS = """
  SELECT CASE WHEN l.doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, quality AS label,
         ((l.doc_id * 37 + n_chars) % 101) / 202.0::DOUBLE + quality * 0.25::DOUBLE + 0.125::DOUBLE
           AS probability
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


# -- handbook: every page is a book of one section and two leaf chapters ------

_TITLE, _HEAD = r"<title>([^\n]*?)</title>", r"<h1>([^\n]*?)</h1>"
_PARA, _FOOT = r"<p>([^\n]*?)</p>", r"<footer>([^\n]*?)</footer>"


def books(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    html = F.col("html")
    title = F.regexp_extract(html, _TITLE, 1)
    first = F.regexp_extract(html, _PARA, 1)
    text = lambda *parts: F.array(*[F.struct(x.alias("headingText")) for x in parts])

    def chapter(number, name, level, content):
        return F.struct(
            (F.col("page_id") * 10 + number).alias("chapterId"), name.alias("chapterTitle"),
            F.lit(level).alias("chapterLevel"),
            F.array(*[F.struct(F.lit(h).alias("headingTitle"), c.alias("contributions"))
                      for h, c in content]).alias("content"),
            F.array(F.struct(F.lit("Figure").alias("type"), title.alias("legend"),
                             F.col("url").alias("imageUrl"), F.lit("").alias("title"),
                             F.lit("").alias("tablehtml")),
                    F.struct(F.lit("Table").alias("type"), F.lit("").alias("legend"),
                             F.lit("").alias("imageUrl"),
                             F.concat(F.lit("<b>"), title, F.lit("</b>")).alias("title"),
                             first.alias("tablehtml"))).alias("attachment"))

    main = chapter(1, F.regexp_extract(html, _HEAD, 1), 4, [
        ("Definition", text(first)), ("Histopathology", text(html)),
        ("Subtype(s)", text(title, F.lit("; "), F.regexp_extract(html, _FOOT, 1)))])
    foot = chapter(2, F.regexp_extract(html, _FOOT, 1), 4, [("Staging", text(html))])
    part = chapter(3, title, 3, [("Definition", text(title))])
    section = F.struct(title.alias("chapterTitle"), F.lit(1).alias("chapterLevel"),
                       F.array(main, foot, part).alias("chapters"))
    return p.select(F.col("page_id").alias("bookid"), title.alias("bookTitle"),
                    F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("series"),
                    F.col("url").alias("revision"), F.array(section).alias("sections"))


LEAVES = f"""
  SELECT page_id AS "bookId", regexp_extract(html, '{_TITLE}', 1) AS "bookTitle",
         page_id * 10 + 1 AS "chapterId", regexp_extract(html, '{_HEAD}', 1) AS "chapterTitle"
  FROM pages
  UNION ALL
  SELECT page_id, regexp_extract(html, '{_TITLE}', 1), page_id * 10 + 2,
         regexp_extract(html, '{_FOOT}', 1)
  FROM pages"""
