"""Ranking of extraction models by preference and free memory, and the attempts that follow from it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: preferred models, best first, with the GiB each needs
CATALOGUE = [("mistral:7b", 9.0), ("qwen2.5:3b", 5.0), ("phi3:mini", 3.0)]
#: fixed values: context and output tokens, and their bounds in the second profile
CONTEXT, OUTPUT, SAFE_CONTEXT, SAFE_OUTPUT = 4096, 4096, 2048, 1024
PAUSE_BELOW_GB = 2.5
NONE_INSTALLED = "no local models installed"


def should_pause(free_gb: Column) -> Column:
    return free_gb < PAUSE_BELOW_GB


def items_of(response: Any) -> list:
    """The listed items of a service's reply: a list, a mapping with ``models``, or an object with it."""
    if response is None or isinstance(response, list):
        return response or []
    got = response.get("models") if isinstance(response, dict) else getattr(response, "models", None)
    return list(got or [])


def names_of(response: Any) -> list[str]:
    """The names in a listing of local or running models, in its order; nameless items are left out."""
    get = lambda x, k: x.get(k) if isinstance(x, dict) else getattr(x, k, None)
    return [n for n in (get(x, "model") or get(x, "name") for x in items_of(response)) if n]


def content_of(response: Any) -> str:
    """The text of a chat reply, mapping or object; an empty object where there is none."""
    get = lambda x, k, d: x.get(k, d) if isinstance(x, dict) else getattr(x, k, d)
    message = get(response, "message", None)
    return "{}" if message is None else get(message, "content", "{}")


def listed(spark, response: Any, free_gb: float, host: str = "local") -> DataFrame:
    """The rows that ``candidates`` takes, from a listing; one per name. A listing is a short driver value."""
    names = list(dict.fromkeys(names_of(response)))
    return spark.createDataFrame([(host, n, i, float(free_gb)) for i, n in enumerate(names)], "host string, name string, list_pos int, free_gb double")


def candidates(available: DataFrame, host: str = "host") -> DataFrame:
    """available: (host, name, list_pos, free_gb). Adds tier (0 preferred and fits, 1 preferred, 2 other)
    and rank per host. The catalogue is three rows, so the broadcast has a fixed size."""
    spark = available.sparkSession
    prefs = spark.createDataFrame([(n, g, i) for i, (n, g) in enumerate(CATALOGUE)], "name string, need_gb double, pref int")
    tiered = available.join(F.broadcast(prefs), "name", "left").withColumn("tier", F.when(F.col("pref").isNull(), 2).when(F.col("free_gb") >= F.col("need_gb"), 0).otherwise(1))
    order = F.struct("tier", F.coalesce("pref", F.col("list_pos")).alias("o"), "list_pos", "name")
    return tiered.withColumn("sort_key", order)


def choose(available: DataFrame, host: str = "host", hosts: DataFrame | None = None) -> DataFrame:
    """One decision per host: the first candidate, downgraded unless it is the catalogue's first. A host of
    ``hosts`` (host, free_gb) without any model decides for none, downgraded."""
    named = candidates(available.where("coalesce(name, '') <> ''").dropDuplicates([host, "name"]), host)
    ranked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_key", "name"))), lambda x: x["name"]), ", ")
    chosen = named.groupBy(host).agg(F.min_by("name", "sort_key").alias("model"), F.max("free_gb").alias("__free"), F.count("*").alias("n_candidates"), ranked.alias("__all"))
    if hosts is not None:
        chosen = hosts.select(host, "free_gb").join(chosen, host, "left").withColumn("__free", F.coalesce("__free", "free_gb"))
    return chosen.select(
        host,
        F.coalesce("model", F.lit("")).alias("model"),
        F.bround("__free", 2).alias("free_ram_gb"),
        F.coalesce("n_candidates", F.lit(0).cast("bigint")).alias("n_candidates"),
        (F.coalesce("model", F.lit("")) != CATALOGUE[0][0]).alias("downgraded"),
        F.when(F.col("model").isNull(), NONE_INSTALLED).otherwise(F.concat(F.lit("selected "), "model", F.lit(" from "), "__all")).alias("reason"),
    )


def profiles(context: int = CONTEXT, output: int = OUTPUT, temperature: float = 0.0) -> list[tuple[str, dict]]:
    """The two ways in which a model is asked, in order: as set, then small and without a GPU."""
    safe = {"temperature": 0, "num_ctx": min(SAFE_CONTEXT, context), "num_predict": min(SAFE_OUTPUT, output), "num_gpu": 0}
    return [("default", {"temperature": temperature, "num_ctx": context, "num_predict": output}), ("cpu_safe", safe)]


def attempts(available: DataFrame, host: str = "host", context: int = CONTEXT, output: int = OUTPUT) -> DataFrame:
    """Every candidate with both profiles, numbered per host in the order in which they are tried. Two
    profiles are a literal array, so this is an explode and no join."""
    from pyspark.sql import Window

    kinds = [F.struct(F.lit(i).alias("k"), F.lit(n).alias("profile"), F.lit(o["num_ctx"]).alias("num_ctx"), F.lit(o["num_predict"]).alias("num_predict")) for i, (n, o) in enumerate(profiles(context, output))]
    each = candidates(available, host).select(host, "name", "sort_key", F.explode(F.array(*kinds)).alias("p"))
    turn = F.row_number().over(Window.partitionBy(host).orderBy("sort_key", "p.k"))
    return each.select(host, "name", "p.profile", "p.num_ctx", "p.num_predict", turn.alias("attempt"))


class Reply(NamedTuple):
    model: str
    downgraded: bool
    reason: str
    raw: str


def fallback(names: Iterable[str], call: Callable[[str, str, dict], Any], log: Callable[[str, str], None] | None = None, **options) -> Callable[[str], Reply]:
    """A provider that asks ``call(model, prompt, options)`` of one model and profile after another until
    one answers; names are ranked, best first. All failing is a RuntimeError that lists the models."""
    names = list(names)

    def say(message: str) -> None:
        if log:
            try:
                log("ai", message)
            except Exception:  # a listener's failure is not the provider's
                pass

    def ask(prompt: str) -> Reply:
        if not names:
            raise RuntimeError(NONE_INSTALLED)
        for name in names:
            for profile, opts in profiles(**options):
                try:
                    say(f"chat attempt model={name} profile={profile}")
                    got = content_of(call(name, prompt, opts))
                    return Reply(name, name != names[0], f"used {name}({profile})", got)
                except Exception as e:  # whatever a service raises, the next one is tried
                    say(f"chat failed model={name} profile={profile} error={e}")
        raise RuntimeError("All candidate models failed: " + " | ".join(names))

    return ask
