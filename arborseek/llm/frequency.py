"""Occurrences and record counts of every term or n-gram, by suffix-sorted counting.

Every position of a record gives one suffix of at most ``longest`` terms, which carries all n-grams that begin
there. Suffixes are routed by their first term, sorted in reverse lexicographic order, and one pass with a stack
gives the counts of all their prefixes: when the next suffix shares only ``k`` terms with the stack, everything
deeper is complete and leaves.

Record sets are kept as numbers. Within one record the suffixes are sorted, and a suffix that shares its first
``k`` terms with the one before it opens the record for its prefixes longer than ``k`` only. The pair
(suffix, k) can thus be counted before the shuffle like any key: occurrences add to all prefixes, the record adds
to those longer than ``k``, and both sums are exact. No set of record ids exists anywhere, so a term that stands in
a third of all rows costs one small row per input partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborseek.functions.text import terms
from arborseek.operators.current import current_rows

SEP = "\x01"  # sorts before every character of a term
SALTS = 16  # parts into which the suffixes of one first term are routed, by their second term


def tag_values(tags: Column | str) -> Column:
    """Whole tags lower-cased without outer blanks, empty and null ones left out; null gives none."""
    col = F.col(tags) if isinstance(tags, str) else tags
    clean = F.transform(col, lambda t: F.regexp_replace(F.lower(t), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.coalesce(F.filter(clean, lambda t: t != ""), F.array().cast("array<string>"))


def sorted_suffixes(records: DataFrame, longest: int) -> DataFrame:
    """``(field_name, suffix, shared)``, one row for each position of each record.

    ``shared`` says how many first terms a suffix has in common with the one before it, in sorted order, in its
    record. Arrays that are used twice are columns of their own: within a lambda they would be made anew for
    every element.
    """
    kept = records.where("field_name is not null and size(terms) > 0").select("field_name", F.array_compact("terms").alias("terms"))
    if longest == 1:
        cut = F.col("terms")
    else:
        shifts = [F.col("terms")] + [F.slice("terms", F.lit(k), F.size("terms")) for k in range(2, longest + 1)]
        named = [x.alias(f"t{k}") for k, x in enumerate(shifts)]
        cut = F.transform(F.arrays_zip(*named), lambda z: F.concat_ws(SEP, *(z[f"t{k}"] for k in range(longest))))
    ordered = kept.select("field_name", F.sort_array(cut).alias("ordered"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("ordered"))
    pairs = ordered.select("field_name", F.inline(F.arrays_zip(F.col("ordered").alias("suffix"), before.alias("before")))).where("suffix is not null")
    same = lambda k: F.concat(F.substring_index("suffix", SEP, k), F.lit(SEP)) == F.concat(F.substring_index("before", SEP, k), F.lit(SEP))
    if longest == 1:
        shared = F.when(F.col("suffix") == F.col("before"), 1)
    else:
        length = lambda c: F.size(F.split(c, SEP))
        shorter = F.least(length("suffix"), length("before"))
        shared = None
        for k in range(longest, 0, -1):
            hit = (shorter >= k) & same(k)
            shared = F.when(hit, k) if shared is None else shared.when(hit, k)
    return pairs.select("field_name", "suffix", shared.otherwise(0).alias("shared"))


def _stack(longest: int):
    """Prefix counts of suffixes that come in reverse lexicographic order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[str] = []  # terms of the open prefixes
        sums: list[list[int]] = []  # occurrences and records of each
        field = None
        out: list[tuple] = []

        def close(depth: int) -> None:
            while len(top) > depth:
                n, r = sums.pop()
                out.append((field, SEP.join(top), len(top), n, r))
                top.pop()
                if sums:
                    sums[-1][0] += n
                    sums[-1][1] += r

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 5
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["field_name", "ngram", "n", "occurrences", "records"])
            out.clear()
            return made

        for b in batches:
            for name, suffix, shared, count in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if name != field:
                    close(0)
                    field = name
                parts = suffix.split(SEP) if longest > 1 else [suffix]
                k = 0
                while k < len(top) and k < len(parts) and top[k] == parts[k]:
                    k += 1
                close(k)
                for p in parts[k:]:
                    top.append(p)
                    sums.append([0, 0])
                # occurrences run down the stack when prefixes close; a record counts for prefixes longer than
                # `shared`, so it is put in at the top and taken out again at depth `shared`
                sums[-1][0] += count
                sums[-1][1] += count if len(parts) > shared else 0
                if 0 < shared < len(parts):
                    sums[shared - 1][1] -= count
            if len(out) > 20000:
                yield batch()
        close(0)
        yield batch()

    return run


def ngram_counts(records: DataFrame, longest: int = 1, salts: int = SALTS) -> DataFrame:
    """``(field_name, ngram, n, occurrences, records)`` of ``records(field_name, terms)``, one row a record.

    All n-grams of 1 to ``longest`` terms, joined by U+0001. A record whose terms are null or empty holds none; null
    terms within one are left out, as are rows without a field name. Repeated rows are records of their own. Other
    columns are ignored.
    """
    counted = sorted_suffixes(records, longest).groupBy("field_name", "suffix", "shared").agg(F.count("*").alias("count"))
    first = F.substring_index("suffix", SEP, 1)
    second = F.when(F.lit(longest > 1), F.pmod(F.xxhash64(F.substring_index("suffix", SEP, 2)), F.lit(salts))).otherwise(0)
    routed = counted.repartition("field_name", first, second).sortWithinPartitions(F.desc("field_name"), F.desc("suffix"))
    made = routed.mapInArrow(_stack(longest), "field_name string, ngram string, n int, occurrences long, records long")
    if longest == 1:
        return made
    # only single terms can have been counted in several parts
    return made.groupBy("field_name", "ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """``(field_name, terms)``: the terms of body and the values of tags of every current row."""
    rows = current_rows(chunks, "body", "tags")
    both = F.array(F.struct(F.lit("body").alias("field_name"), terms("body").alias("terms")), F.struct(F.lit("tags").alias("field_name"), tag_values("tags").alias("terms")))
    return rows.select(F.inline(both))


def verdicts(counts: DataFrame, total: int, fewest: int = 3, share: tuple[int, int] = (1, 5)) -> DataFrame:
    """Adds ``verdict``: ``rare`` below ``fewest`` records, ``common`` above the share (a fraction) of ``total``, else null."""
    common = F.col("records") * share[1] > F.lit(total * share[0])
    return counts.withColumn("verdict", F.when(F.col("records") < fewest, "rare").when(common, "common"))


def current_total(chunks: DataFrame) -> int:
    """The number of current rows: that of distinct ids, a scan of one column."""
    return chunks.where("id is not null").select("id").distinct().count()
