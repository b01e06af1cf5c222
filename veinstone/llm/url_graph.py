"""URL filters: explicit rules, and trust spread over the graph of hosts for what no rule decides.

Hosts are linked by the links of their pages (weighed by their number): absolute and protocol-relative ones in any of
``ATTRIBUTES``, and relative ones of a page whose base is another host. Besides, with weight ``FAMILY`` and in both
directions, each is linked to the host one label shorter, up to its registrable domain, whether that has pages or not: so
a domain is tied to all its subdomains, and nothing crosses a public suffix or a shared host (``is_suffix``).

Pages that a rule allows make their host a trusted seed, pages that a rule blocks a blocked seed, by their numbers.
Personalised PageRank carries trust along links; distrust goes against them (who links to the blocked is suspect). A host
is blocked if more than ``LEAST_SHARE`` of what reached it is distrust. Scores shrink with the corpus, so only their
unrounded ratio counts.

``ROUNDS`` steps leave ``DAMPING ** ROUNDS`` (under 1 %) of the mass on the way; the spreading ends before if a step changes
less than ``SETTLED`` of it. Mass that dangling hosts would return to the seeds is left out: that scales all scores of a
kind alike. The graph is aggregated to host pairs (map-side) before the iterations, each of which is one join and one
group-by on narrow rows, cut every few rounds; no links or scores reach the driver, and a hot host is only a hot join key,
which adaptive execution splits.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is allowed. A page without html
has no links. Repeated rows count and are judged each. Other columns pass through under any name, those with the name of
a result are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sealed, cut, let, table

#: Fixed rules: verdict and rule (host and path).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
MOST_RULES = 500
DAMPING, ROUNDS, SETTLED, FAMILY, LEAST_SHARE = 0.85, 29, 1e-9, 1.0, 0.5
#: With up to this many edges the scores (two for a host at most) go to all executors in each step, else steps are joined by a shuffle.
BROADCAST_EDGES = 2_000_000
#: With up to this many hosts their scores go to the pages, else both are joined by a shuffle.
BROADCAST_HOSTS = 1_000_000
#: Edges of a partition.
TASK_EDGES = 200_000
#: IP addresses, which are not subdomains of anything.
_ADDRESS = r"^(\[|[0-9]+(\.[0-9]+){3}(:|$))"
#: Attributes that hold links, and ``url`` as in a refresh.
ATTRIBUTES = ("href", "src", "action", "formaction", "cite", "data", "poster", "background", "longdesc", "manifest", "url")
#: Fixed word lists: labels below a country's that belong to its registry, and domains whose subdomains have owners of their own.
REGISTRY = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "web")
SHARED = ("appspot.com", "blogspot.com", "cloudfront.net", "fandom.com", "github.io", "gitlab.io", "herokuapp.com", "livejournal.com", "neocities.org", "netlify.app", "pages.dev", "substack.com", "tumblr.com", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def is_suffix(host: Column) -> Column:
    """Whether names right below this one have owners of their own: a top label, a country's registry label, or a shared domain."""
    shared = "|".join(x.replace(".", "\\.") for x in SHARED)
    return host.rlike(f"^([^.]+|({'|'.join(REGISTRY)})\\.[a-z][a-z]|{shared})\\.*(:[0-9]*)?$")


def linked_hosts(html: Column) -> Column:
    """array<string>: the host of every link of a page that names one, by itself or by the page's base."""
    page = F.coalesce(html, F.lit(""))
    links = F.regexp_extract_all(page, F.lit(f"(?i)\\b(?:{'|'.join(ATTRIBUTES)})\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"), F.lit(1))
    base = F.when(page.rlike("(?i)<base\\b"), host_of(F.concat(F.lit("x:"), F.regexp_extract(page, "(?i)<base\\b[^>]*?\\bhref\\s*=\\s*[\"']?\\s*(?:https?:)?(//[^\"'\\s>]+)", 1)))).otherwise("")
    absolute = lambda x: F.when(F.startswith(x, F.lit("//")), host_of(F.concat(F.lit("x:"), x))).when(x.rlike("(?i)^https?://"), host_of(x))
    relative = lambda x, own: F.when((own == "") | x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), F.lit("")).otherwise(own)
    # The base is found once for a page, and links are only looked at again if they can name a host.
    named = lambda x, own: F.when(F.contains(x, F.lit("//")) | (own != ""), F.coalesce(absolute(x), relative(x, own))).otherwise("")
    return let(base, lambda own: F.filter(F.transform(links, lambda x: named(x, own)), lambda x: x != ""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts of ``pages`` (host, html); all html is read once."""
    seen = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(linked_hosts(F.col("html"))).alias("dst")).filter("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    seen = cut(seen)
    hosts = pages.filter("host != ''").select("host").union(seen.select("dst")).distinct()
    labels = F.size(F.split("host", "\\."))
    steps = hosts.filter((labels > 2) & ~F.col("host").rlike(_ADDRESS)).select("host", F.explode(F.sequence(F.lit(3), labels)).alias("n"))
    upward = steps.select(F.expr("substring_index(host, '.', -n)").alias("src"), F.expr("substring_index(host, '.', 1 - n)").alias("dst")).filter(F.col("dst").rlike("[^.]\\.+[^.]") & ~is_suffix(F.col("dst"))).distinct()
    family = upward.union(upward.select("dst", "src")).withColumn("weight", F.lit(FAMILY))
    return seen.union(family).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` steps from seeds (host, trusted, blocked), whose columns each sum to 1 or 0."""
    edges = cut(edges)
    many = edges.count()
    few, tasks = many <= BROADCAST_EDGES, -(-many // TASK_EDGES) or 1
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    whole = edges.join(out, "src").join(into, "dst")
    along = whole.select(F.col("src").alias("at"), F.lit(True).alias("good"), F.col("dst").alias("to"), (F.col("weight") / F.col("out") * damping).alias("share"))
    against = whole.select(F.col("dst").alias("at"), F.lit(False).alias("good"), F.col("src").alias("to"), (F.col("weight") / F.col("into") * damping).alias("share"))
    # As many partitions as the graph asks for, so that a step is not mostly empty files.
    steps = cut(along.union(against).coalesce(tasks))
    start = cut(seeds.select(F.col("host").alias("at"), F.lit(True).alias("good"), (F.col("trusted") * (1 - damping)).alias("score")).union(seeds.select("host", F.lit(False), F.col("blocked") * (1 - damping))).filter("score > 0").coalesce(tasks))
    scores, total = start, None
    for k in range(rounds):
        moved = steps.join(F.broadcast(scores) if few else scores, ["at", "good"]).select(F.col("to").alias("at"), "good", (F.col("score") * F.col("share")).alias("score"))
        scores = moved.union(start).groupBy("at", "good").agg(F.sum("score").alias("score"))
        if k % 4 == 3 or k == rounds - 1:
            scores = cut(scores.coalesce(tasks))
            before, total = total, scores.agg(F.coalesce(F.sum("score"), F.lit(0.0))).head()[0]
            if before is not None and total - before <= settled * total:
                break  # the sum only grows, by what is still on the way
    of = lambda good: F.sum(F.when(F.col("good") == good, F.col("score")).otherwise(0.0))
    return scores.groupBy(F.col("at").alias("host")).agg(of(True).alias("trust"), of(False).alias("distrust"))


def suspect(trust: Column, distrust: Column, least_share: float) -> Column:
    """If distrust is more than ``least_share`` of both. Scores shrink as the corpus grows, so only their ratio counts; the slack is for sums in another order."""
    return distrust * (1 - least_share) > trust * (least_share * (1 + 1e-9))


def shown(score: Column) -> Column:
    """The score to nine significant digits."""
    return F.format_string("%.8e", score).cast("double")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``pages`` (url, html and others) with host, path, rule, verdict, trust and distrust in place of html."""
    sealed = Sealed(pages)
    placed = sealed.df.withColumns({"host": host_of(sealed.of("url")), "path": path_of(sealed.of("url"))})
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "said": said})
    counts = ruled.filter("said is not null").groupBy("host").agg(F.sum(F.when(F.col("said") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("said") == "block", 1).otherwise(0)).alias("b"))
    counts = cut(counts)
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).head()
    seeds = counts.select("host", (F.col("a") / max(1, total[0])).alias("trusted"), (F.col("b") / max(1, total[1])).alias("blocked"))
    scores = spread(host_edges(placed.select("host", sealed.of("html", "string").alias("html"))), seeds)
    scores = scores.select("host", suspect(F.col("trust"), F.col("distrust"), least_share).alias("suspect"), shown(F.col("trust")).alias("trust"), shown(F.col("distrust")).alias("distrust"))
    scores = cut(scores)
    out = ruled.join(F.broadcast(scores) if scores.count() <= BROADCAST_HOSTS else scores, "host", "left")
    verdict = F.coalesce("said", F.when(F.col("suspect"), "block").otherwise("allow"))
    results = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": verdict, "trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))}
    return sealed.opened(out, results, ("html",))


def op1_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
