"""A corpus pipeline: each stage takes documents and returns what goes on.

Toxic documents go; of near duplicates one stays; personal data is blotted
out; sources are mixed to their target weights; what is left becomes token
ids.

Inputs, as each stage's operator says: a null or empty text is not toxic, is
no duplicate, holds nothing private, and ends at the mix, which takes words;
of repeated rows one stays; of a tie the least doc_id stays; very long texts
go through whole; a null source is a source; a null doc_id is an id of its
own; an empty table gives an empty one with the last stage's columns. Further
columns pass through all stages but the last, which gives (doc_id, ids);
names that begin with ``__fl_`` are the operators'.
"""

import uuid

from foliolake.llm import mixing, near_dup, pii, sentence_pieces, toxicity
from foliolake.llm._common import shared_dir, table


def drop_toxic(spark, docs, sf_dir):
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored_rows(docs, scorer).where("__fl_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    return near_dup.deduplicated(docs)


def redact(spark, docs, sf_dir):
    return pii.redacted(docs)


def mix(spark, docs, sf_dir):
    return mixing.mixed(docs)


def encode(spark, docs, sf_dir):
    return sentence_pieces.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("sentence_pieces", encode)]

ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/foliolake/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        made, path = stage(spark, docs, sf_dir), f"{base}/{k}-{name}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
