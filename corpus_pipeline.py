"""Training corpus from documents: screened for toxicity, de-duplicated, freed of personal data, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
to the shared folder and reads again as the next stage's docs. All stages but the last
return the columns of documents. Null texts count as empty in every stage; empty tables stay
empty; extra columns are carried along up to the last stage.
"""

import uuid

from parapet.llm import mixing, packing, pii, simhash, toxicity
from parapet.llm.common import shared_dir, table
from parapet.llm.queries import vocabulary

ORACLE_SQL = None  # trained model, fingerprints and token ids: tested against brute force


def screen(spark, docs, sf_dir):
    """Documents that the toxicity model does not reject; it learns from the labels of those at hand."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark, docs, sf_dir):
    """One document of each group of near-duplicates: SimHash of three-word shingles, at most 3 differing bits."""
    return simhash.representatives(docs)


def redact(spark, docs, sf_dir):
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def mix(spark, docs, sf_dir):
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """Pieces of the documents with their place in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", screen), ("near_duplicates", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/corpus-pipeline/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
