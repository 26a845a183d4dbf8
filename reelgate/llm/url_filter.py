"""URL filter: site rules first, else logistic regression on hashed character n-grams.

A rule names a host and a path; it fits that host and its subdomains where the path starts with
the rule's, and the longest fitting rule decides. URLs that no rule fits are judged by a logistic
regression on the hashed character n-grams of host and path, trained from a small table of
labelled URLs. Everything runs in built-in columns and the DataFrame-based ML library.

Shapes at scale: one scan of the url column and no shuffle of it. Training reads at most ``LABELLED``
labelled rows, the first by hash; the model is ``FEATURES`` numbers. Rules are an expression, so
their list should stay short (thousands belong in a table).

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and
is judged by the model like others; repeated rows are judged alike. With labels of one class only,
that class is the verdict; without labels, ``allow``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgate.llm.tables import ascii_lower

FEATURES = 1 << 14
GRAMS = (3, 4, 5)
#: Labelled URLs used for training, at most.
LABELLED = 20_000
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values).
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(
            path, F.lit(rule.path)
        )
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def grams(host: Column, path: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """The character n-grams of host and path, with marks at both ends."""
    letters = F.split(F.concat(F.lit("^"), host, path, F.lit("$")), "")

    def of(chars: Column) -> Column:
        return F.flatten(
            F.array(
                *[
                    F.transform(
                        F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1))),
                        lambda i, n=n: F.array_join(F.slice(chars, i, n), ""),
                    )
                    for n in sizes
                ]
            )
        )

    # the lambda binds the letters once for all n-grams
    return F.flatten(F.transform(F.array(letters), of))


def hashed(rows: DataFrame) -> DataFrame:
    """Rows with host and path, and the vector of their n-grams as ``features``."""
    worded = rows.withColumn("__grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, inputCol="__grams", outputCol="features").transform(worded).drop("__grams")


def train(labelled: DataFrame, limit: int = LABELLED) -> LogisticRegressionModel | str:
    """A model of labelled URLs (host, path, verdict), or the verdict when there is but one."""
    few = (
        labelled.select("host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label"))
        .orderBy(F.xxhash64("host", "path"), "host", "path", "label")
        .limit(limit)
    )
    classes = {row["label"] for row in few.select("label").distinct().collect()}
    if len(classes) < 2:
        return BLOCK if 1.0 in classes else ALLOW
    learner = LogisticRegression(maxIter=50, regParam=0.0001, standardization=False)
    # one bounded partition in a fixed order: the sums of a rerun are the same to the last bit
    return learner.fit(hashed(few.coalesce(1)))


def judge(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    *,
    rules: Sequence[Rule] = RULES,
    limit: int = LABELLED,
) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block (null where a rule decides).

    ``labelled`` has host, path and verdict; without it, the URLs that rules decide are the
    labelled table, and the model carries the rules' taste over to sites they do not name.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", text.alias("rule"), verdict.alias("verdict"))
    ruled, rest = rows.where(F.col("rule").isNotNull()), rows.where(F.col("rule").isNull())
    model = train(ruled if labelled is None else labelled, limit)
    unsure = F.lit(None).cast("double")
    if isinstance(model, str):
        judged = rest.withColumn("verdict", F.lit(model)).withColumn("p_block", unsure)
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(hashed(rest))
        judged = scored.select(
            "page_id",
            "host",
            "path",
            "rule",
            F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW).alias("verdict"),
            vector_to_array("probability")[1].alias("p_block"),
        )
    return ruled.withColumn("p_block", unsure).unionByName(judged)
