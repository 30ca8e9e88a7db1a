"""From a dump to a table of labelled pairs, six stages that are each resumable, and to feature rows; external services as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import sentences
from textloom.operators import graph, kb, mentions, pairs, sampling, trees
from textloom.sources import dump
from textloom.streaming.resume import stage


def build(spark: SparkSession, pages_path: str, out: str, provider, sitelinks: DataFrame, triples: DataFrame, properties: DataFrame, n_articles: int, prefix: str, language: str = "fr", seed: int = 17) -> DataFrame:
    """provider(sentences with id_article, pos, sentence) gives mentions (id_article, pos, start, end, surface_form, wiki_id, entity_type); sitelinks (lemma, item); triples (s, p, o); properties (p, name)."""
    chosen = sampling.sample(dump.accepted(dump.read_pages(spark, pages_path)), "id", n_articles, seed)
    articles = stage(chosen, f"{out}/articles", "id", lambda df: dump.articles(df, prefix, language))
    texts = articles.select(F.col("id").alias("id_article"), "text")
    sents = stage(texts, f"{out}/sentences", "id_article", lambda df: sentences.sentences(df, "id_article"))

    def found(df: DataFrame) -> DataFrame:
        rows = provider(df.select("id_article", "pos", "sentence")).where(mentions.real_name(F.col("surface_form")))
        surface, end = mentions.normalised(F.col("surface_form"), F.col("end"))
        rows = rows.withColumns({"surface_form": surface, "end": end, "wikidata_id": F.lit(None).cast("string")})
        return kb.link(rows, sitelinks)

    entities = stage(sents, f"{out}/entities", "id_article", found)
    columns = ["start", "end", "surface_form", "entity_type", "wikidata_id"]

    def paired(df: DataFrame) -> DataFrame:
        both = pairs.oriented(pairs.both_linked(pairs.near(df, ["id_article", "pos"], ["end"], columns)), columns)
        asked = both.withColumn("entity1", F.col("wikidata_id1")).withColumn("entity2", F.col("wikidata_id2"))
        return kb.label(asked, triples, properties)

    return stage(entities, f"{out}/entities_pairs", "id_article", paired)


def features(spark: SparkSession, out: str, tokens: DataFrame, which: str = "both", sample: DataFrame | None = None) -> dict[str, DataFrame]:
    """Feature rows of the pairs that build() has left in `out`: "ours" (shortest paths), "xu" (branches), or both.

    tokens: parsed sentences (id_article, sentence_no, idx, word, lemma, pos, head, rel). sample: rows with id_entities_pair, to keep to
    the pairs of an earlier run. A sentence is parsed and contracted once for all its pairs. A mention stands where its
    words are first found; one that is not found has null paths.
    """
    if which not in ("both", "ours", "xu"):
        raise ValueError("which must be both, ours or xu")
    sid = F.concat_ws(":", "id_article", "pos").alias("sid")
    said = spark.read.parquet(f"{out}/sentences").select(sid, F.col("sentence").alias("original_sentence"))
    found = spark.read.parquet(f"{out}/entities_pairs").select(
        sid, F.concat_ws(":", "id_article", "pos", "start1", "start2").alias("id_entities_pair"), F.col("start1").alias("id1"), F.col("start2").alias("id2"), F.col("surface_form1").alias("entity1"), F.col("surface_form2").alias("entity2"),
        F.col("entity_type1").alias("ent1type"), F.col("entity_type2").alias("ent2type"), F.col("relation_id").alias("relation"),
    )
    rows = (found if sample is None else trees.same_sample(found, sample)).join(said, "sid")
    parsed = tokens.withColumn("sid", F.concat_ws(":", "id_article", "sentence_no")).drop("id_article", "sentence_no")
    packed, made = trees.trees(parsed, "sid"), {}
    if which != "ours":
        made["xu"] = trees.features_xu(rows, packed, "sid")
    if which != "xu":
        blank = graph.blanked(parsed.select("sid", "idx", "word"), "sid").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("w"))
        names = rows.select("sid", F.explode(F.array("entity1", "entity2")).alias("name")).distinct()
        places = names.join(blank, "sid").select("sid", "name", "w.idx", graph.find(F.col("w.word"), mentions.tokens(F.col("name"))).alias("places"))
        at = lambda nth: F.get("idx", nth - 1)
        every = places.select("sid", "name", "idx", F.posexplode("places").alias("nth", "p")).select("sid", "name", "nth", at(F.col("p.first")).alias("start"), at(F.col("p.last")).alias("end"))
        spans = graph.longest(every.where("`end` > start"), "sid").select("sid", F.col("start").alias("first"), F.col("end").alias("last"))
        nodes = graph.contracted(parsed, spans, "sid")
        graphs = graph.contracted_edges(nodes, "sid").groupBy("sid").agg(F.collect_list(F.struct("u", "v", "weight")).alias("edges"))
        first = every.where("nth = 0").select("sid", "name", F.col("start").alias("idx")).join(nodes.select("sid", "idx", "node"), ["sid", "idx"])
        of = lambda entity, end: first.select("sid", F.col("name").alias(entity), F.col("node").alias(end))
        asked = rows.join(of("entity1", "a"), ["sid", "entity1"], "left").join(of("entity2", "b"), ["sid", "entity2"], "left")
        made["ours"] = trees.features_ours(rows, graph.paths(asked.select("id_entities_pair", "sid", "a", "b"), graphs, packed, "sid"))
    return made
