"""Vocabulary operators: parts as concepts, lines as coded events."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from medweave.bindings.common import query
from medweave.functions import vocabulary as fv
from medweave.operators import vocab
from medweave.session import settle

# Domains given to parts in turn; two of them route nowhere.
DOMAINS = [*fv.DESTINATION, "Metadata", "Gender"]
VOCABULARIES = ["ICD9CM", "ICD9Proc", "CPT4", "HCPCS", "NDC", "SNOMED"]

_DOMAIN_ROWS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(DOMAINS))
_VOCAB_ROWS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(VOCABULARIES))
_ROUTES = ", ".join(f"('{k}', '{v}')" for k, v in fv.DESTINATION.items())

CONCEPTS = f"""
domains(i, domain_id) AS (VALUES {_DOMAIN_ROWS}), vocabs(i, vocabulary_id) AS (VALUES {_VOCAB_ROWS}), routes(domain_id, destination) AS (VALUES {_ROUTES}),
concept AS (
  SELECT p_partkey AS concept_id, domain_id, vocabulary_id, substr(p_brand, 7) || '.' || CAST(p_size AS VARCHAR) || '.' AS concept_code
  FROM part JOIN domains ON domains.i = p_partkey % {len(DOMAINS)} JOIN vocabs ON vocabs.i = p_size % {len(VOCABULARIES)}
), relationship AS (
  SELECT p_partkey AS id1, l.target AS id2, CASE WHEN p_partkey % 13 = 0 THEN 'Mapped from' ELSE 'Maps to' END AS relationship_id,
         CASE WHEN p_partkey % 11 = 0 THEN 'D' ELSE '' END AS invalid_reason, l.j AS j
  FROM part, LATERAL (SELECT 0 AS j, CAST(floor(p_retailprice) AS BIGINT) AS target UNION ALL SELECT 1, CAST(floor(p_retailprice * 2) AS BIGINT)) l
  WHERE p_type <> 'ECONOMY' AND (l.j = 0 OR p_partkey % 5 = 0)
), maps_to AS (SELECT * FROM relationship WHERE relationship_id = 'Maps to' AND invalid_reason = ''),
sources AS (
  SELECT concept_id, replace(concept_code, '.', '') AS code, destination AS own,
         CASE vocabulary_id WHEN 'CPT4' THEN 'HCPCS' WHEN 'ICD9CM' THEN 'ICD9' WHEN 'ICD9Proc' THEN 'ICD9' ELSE vocabulary_id END AS vocab
  FROM concept LEFT JOIN routes USING (domain_id)
), winners AS (
  SELECT *, concept_id IN (SELECT id1 FROM maps_to) AS linked FROM sources
  WHERE vocab IN ('ICD9', 'HCPCS', 'NDC') AND (own IS NOT NULL OR concept_id IN (SELECT id1 FROM maps_to))
  QUALIFY row_number() OVER (PARTITION BY vocab, code ORDER BY concept_id DESC) = 1
), targets AS (SELECT id1, id2, destination, j FROM maps_to JOIN concept ON concept_id = id2 JOIN routes USING (domain_id)),
concept_map AS (
  SELECT vocab, code, concept_id AS source_id, 0 AS target_id, own AS destination FROM winners WHERE NOT linked
  UNION ALL
  SELECT vocab, code, concept_id, id2, destination FROM winners LEFT JOIN targets ON id1 = concept_id WHERE linked
)
"""


def _pick(values: list[str], index) -> F.Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(enumerate(values))])[index.cast("int")]


def concepts(t):
    key = F.col("p_partkey")
    return t.part.select(
        key.alias("concept_id"), _pick(DOMAINS, key % len(DOMAINS)).alias("domain_id"), _pick(VOCABULARIES, F.col("p_size") % len(VOCABULARIES)).alias("vocabulary_id"),
        F.concat(F.expr("substr(p_brand, 7)"), F.lit("."), F.col("p_size").cast("string"), F.lit(".")).alias("concept_code"), key.alias("ordinal"),
    )


def relationships(t):
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    second = F.when(key % 5 == 0, F.floor(price * 2).cast("long"))
    rows = t.part.where(F.col("p_type") != "ECONOMY").select(key, F.posexplode(F.array(F.floor(price).cast("long"), second)).alias("j", "target"))
    return rows.where(F.col("target").isNotNull()).select(
        key.alias("concept_id_1"), F.col("target").alias("concept_id_2"), F.when(key % 13 == 0, "Mapped from").otherwise("Maps to").alias("relationship_id"),
        F.when(key % 11 == 0, "D").otherwise("").alias("invalid_reason"), (key * 10 + F.col("j")).alias("ordinal"),
    )


def coded(t):
    """Lines as codes: the brand number and size of the part, with some codes no part has."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(part, "l_partkey")
    odd = F.when(F.col("l_linenumber") == 7, "X").otherwise("")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("feed"),
        _pick(["ICD9", "HCPCS", "NDC"], F.col("p_size") % 3).alias("vocab"),
        F.concat(F.expr("substr(p_brand, 7)"), F.col("p_size").cast("string"), odd).alias("code"),
    )


_CODED = """codes AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS feed, CASE p_size % 3 WHEN 0 THEN 'ICD9' WHEN 1 THEN 'HCPCS' ELSE 'NDC' END AS vocab,
         substr(p_brand, 7) || CAST(p_size AS VARCHAR) || CASE WHEN l_linenumber = 7 THEN 'X' ELSE '' END AS code
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _map(t):
    """The map as the conversion uses it: written once, then looked up."""
    return settle(vocab.concept_map(concepts(t), relationships(t)))


@query("concept_map", f"WITH {CONCEPTS} SELECT * FROM concept_map")
def concept_map(t):
    return vocab.concept_map(concepts(t), relationships(t)).drop("target_order")


@query("valid_maps_to", f"WITH {CONCEPTS} SELECT id1 AS concept_id_1, id2 AS concept_id_2 FROM maps_to")
def valid_maps_to(t):
    return vocab.valid_maps_to(relationships(t)).select("concept_id_1", "concept_id_2")


@query("delete_invalid_relationships", f"WITH {CONCEPTS} SELECT id1 AS concept_id_1, id2 AS concept_id_2, relationship_id FROM relationship WHERE invalid_reason = ''")
def delete_invalid_relationships(t):
    return vocab.delete_invalid_relationships(relationships(t)).select("concept_id_1", "concept_id_2", "relationship_id")


@query("resolve_targets", f"WITH {CONCEPTS} SELECT id1 AS source_id, id2 AS target_id, destination FROM targets")
def resolve_targets(t):
    return vocab.resolve_targets(concepts(t), vocab.valid_maps_to(relationships(t))).drop("target_order")


@query("normalise_and_route", f"WITH {CONCEPTS} SELECT concept_id, vocab, code, own AS destination FROM sources WHERE vocab IN ('ICD9', 'HCPCS', 'NDC')")
def normalise_and_route(t):
    rows = concepts(t).select(
        "concept_id", fv.normalise_vocab(F.col("vocabulary_id")).alias("vocab"), fv.normalise_code(F.col("concept_code")).alias("code"),
        fv.route_domain(F.col("domain_id")).alias("destination"),
    )
    return vocab.mappable_vocab(rows)


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "lookup_codes",
    f"""WITH {CONCEPTS}, {_CODED} SELECT {_KEYS}, vocab, code, source_id, target_id, destination, m.vocab IS NOT NULL AS known
        FROM codes LEFT JOIN concept_map m USING (vocab, code)""",
)
def lookup_codes(t):
    found = vocab.lookup_codes(coded(t), _map(t))
    return found.select(*_KEYS.split(", "), "vocab", "code", "source_id", "target_id", "destination", "known")


@query("fact_routing", f"WITH {CONCEPTS}, {_CODED} SELECT destination, count(*) AS n, count(DISTINCT target_id) AS targets FROM codes JOIN concept_map USING (vocab, code) WHERE target_id IS NOT NULL GROUP BY destination")
def fact_routing(t):
    facts = vocab.fact_targets(vocab.lookup_codes(coded(t), _map(t)))
    return facts.groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("targets"))


@query("procedure_facts", f"WITH {CONCEPTS}, {_CODED} SELECT {_KEYS}, target_id FROM codes JOIN concept_map USING (vocab, code) WHERE destination = 'procedure' AND target_id IS NOT NULL")
def procedure_facts(t):
    return vocab.fact_targets(vocab.lookup_codes(coded(t), _map(t)), "procedure").select(*_KEYS.split(", "), "target_id")


@query("unmapped_codes", f"WITH {CONCEPTS}, {_CODED} SELECT {_KEYS}, vocab, code FROM codes WHERE (vocab, code) NOT IN (SELECT (vocab, code) FROM concept_map)")
def unmapped_codes(t):
    return vocab.unmapped_codes(coded(t), _map(t)).select(*_KEYS.split(", "), "vocab", "code")


@query("unmapped_frequency", f"WITH {CONCEPTS}, {_CODED} SELECT vocab, code, count(*) AS n FROM codes WHERE (vocab, code) NOT IN (SELECT (vocab, code) FROM concept_map) GROUP BY ALL HAVING count(*) >= 5")
def unmapped_frequency(t):
    return vocab.unmapped_frequency(coded(t), _map(t), 5)


@query("source_code_summary", f"WITH {_CODED} SELECT feed, vocab, code, count(*) AS n FROM codes GROUP BY ALL")
def source_code_summary(t):
    return vocab.source_code_summary(coded(t))
