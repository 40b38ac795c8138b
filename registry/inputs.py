"""Inputs that the registered queries derive from the given tables.

The given pages lack response metadata, full URLs and most tag and script
forms.  These are added to every row by arithmetic on its columns, so that the
checking SQL can do the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan.functions.urls import registered_domain
from pagescan.options import ScanOptions
from pagescan.sources.readers import spread, text_parts

SUFFIXES = ["com", "net", "org", "co.uk", "com.cn"]
DANGER = ["tion", "un"] + list(ScanOptions().danger_keywords)
OPTIONS = ScanOptions(
    danger_keywords=DANGER, extension_blacklist=[".html", ".css"], public_suffixes=SUFFIXES, max_depth=3, max_urls=100
)

# Appended to each page: one of every form of link, named after the page.
FORMS = """
<link rel="stylesheet" href='/css/s{id}.css'><img src="./img/{id}.png?w=1&amp;h=2" alt="x"><IMG SRC=pic{id}.gif>
<script src=/js/app{id}.js></script><form action="/account/delete?id={id}"><input formaction='../save/{id}' src=btn{id}.png></form>
<iframe src="//cdn.example.net/frame/{id}"></iframe><object data=movie{id}.swf></object><meta content="text/{id}; x">
<a class=x href = '?q={id}#top'>q</a><a href="#/route/{id}">r</a><a href='javascript:go({id})'>j</a><a title="a>b" href="sub/./x/../{id}/">s</a>
<a href="mailto:a{id}@mail.example.com">m</a><a href="/go?u=https://o{id}.example.org/z">g</a><video src=v{id}.mp4></video>
<!-- <a href="/hidden/{id}">h</a> --><style>.a{background:url(/bg/{id}.jpg)}</style>
<script>fetch("/api/v1/items/{id}");axios.get('svc/{id}');$.get(entrance{id});$.post("post/{id}");var u=`/tpl/{id}`;
window.location = "/home{id}";window.open('win{id}');x.src = "/x{id}.js";y.href="y/{id}";z.action='z{id}';
var j={"url":"json/{id}","src":"s{id}.json","href":"\\/esc\\/{id}"};router.push('/push/{id}');router.addRoute("/add{id}");
require("./mod{id}");import("../imp{id}");var v=`https://tpl{id}.example.com/${p}`;var w=`./rel/{id}`;var a="assets/a{id}.js";
var c={"chunk-{hex}":"{xeh}","chunk-a":"b"};<Route path="/rt{id}">;var q='/pg/p{id}.php?x';
</script>"""


# Appended to each document: one made-up secret for every rule, named after the document.
_KEY = "PRIV" + "ATE KEY"
SEEDS = f"""
id 11010519900307{{d3}}X tel 138{{d8}} code {{H16}}ZZ reg {{d8}}12345 net 10.0.{{b}}.1 172.16.{{b}}.9 ip 8.8.{{b}}.8 mac aa:bb:cc:dd:ee:{{h2}}
mail u{{h8}}@mail.example.com f{{h8}}@x.json auth basic {{h16}} AUTH Bearer {{h16}}.x
LTAI{{h16}} AKID{{h16}} AK{{h32}} AKIA{{H16}} AGPA{{H16}} AIza{{h32}}abc AAAA{{h2}}abcde:{{h32}}{{h32}}{{h32}}{{h32}}{{h8}}abcd 6L{{h32}}abcdef ya29.{{h16}}
SK{{h32}} AC{{h32}} AP{{h32}} sk_live_{{h16}}{{h8}} rk_live_{{h16}}{{h8}} https://u{{h8}}:{{h16}}@github.com/x xoxb-{{h16}}
https://hooks.slack.com/services/T{{h8}}/B{{h8}}/{{h16}}{{h8}} key-{{h32}} sqOatp-{{h16}}abcdef sq0csp-{{h32}}abcdefghijk
access_token$production${{h16}}${{h32}} EAACEdEose0cBA{{h16}}
fb_app = "1{{d8}}23456" FACEBOOK: '{{h32}}' twitter key '{{h32}}abcd' Twitter="{{h32}}abc" linkedin = '{{h16}}' GitHub "{{h32}}abcd"
w.oss.aliyuncs.com b{{h8}}.s3.amazonaws.com s3://bucket-{{h8}} cloudinary://1234567{{d8}}:{{h8}}@cloud
mysql://u{{h8}}:p@db.example.com:3306/d{{h8}} jdbc:mysql://db{{h8}}.example.com:3306/x
ey{{h16}}.{{h16}}.{{h8}} -----BEGIN RSA {_KEY}-----
{{h32}}
-----END RSA {_KEY}----- -----BEGIN PGP {_KEY} BLOCK-----
api_key = "{{h16}}" passwd: 'p{{h8}}' token="t{{h8}}" accessKeyId Access-Key accesskey SecretKey SECRET_KEY C:\\\\d{{h8}}\\\\f
db_password = "{{h16}}" config.x:="{{h8}}"
"""


def seeds() -> Column:
    number, digest = F.col("doc_id"), F.md5(F.col("doc_id").cast("string"))
    text = F.lit(SEEDS)
    for size in (32, 16, 8, 2):
        text = F.replace(text, F.lit(f"{{h{size}}}"), F.substring(digest, 1, size))
        text = F.replace(text, F.lit(f"{{H{size}}}"), F.upper(F.substring(digest, 1, size)))
    for size in (8, 3):
        text = F.replace(text, F.lit(f"{{d{size}}}"), F.lpad((number % 10**size).cast("string"), size, "0"))
    return F.replace(text, F.lit("{b}"), (number % 256).cast("string"))


def seeded_documents(plain: DataFrame) -> DataFrame:
    return plain.select("doc_id", F.concat("text", seeds()).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    # The given tables are single files of few row groups.
    path = f"{sf_dir}/{name}.parquet"
    return spread(spark.read.parquet(path), key, text_parts(spark, path))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def own_domain(url: Column) -> Column:
    return registered_domain(url, SUFFIXES)


def forms() -> Column:
    text = F.replace(F.lit(FORMS), F.lit("{id}"), F.col("page_id").cast("string"))
    text = F.replace(text, F.lit("{hex}"), F.substring(F.md5("url"), 1, 8))
    return F.replace(text, F.lit("{xeh}"), F.substring(F.md5("url"), 9, 8))


def rich_pages(plain: DataFrame) -> DataFrame:
    return plain.withColumn("html", F.concat("html", forms()))


def linked_pages(plain: DataFrame) -> DataFrame:
    """Each page with links to the pages numbered 7i+1 and 3i+2, modulo their number."""
    last = plain.agg(F.count("*")).scalar()
    names = plain.select("page_id", "url")
    picks = names.select(
        "page_id", F.explode(F.array((7 * F.col("page_id") + 1) % last, (3 * F.col("page_id") + 2) % last)).alias("other")
    )
    others = names.select(F.col("page_id").alias("other"), F.col("url").alias("link"))
    links = (
        picks.join(others, "other")
        .groupBy("page_id")
        .agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit('<a href="'), "link", F.lit('">n</a>')))), "").alias("links"))
    )
    # Merged, so that the text keeps its partitions and the scan that follows its parallelism.
    return plain.join(links.hint("merge"), "page_id").select("page_id", "url", F.concat("html", "links").alias("html"))


def responses(plain: DataFrame) -> DataFrame:
    """Pages as responses with varied status, errors, headers, redirects and times."""
    i = F.col("page_id")
    slot = i % 20
    failed = slot == 19
    return plain.select(
        "page_id",
        "url",
        F.col("url").alias("original_url"),
        F.when(slot == 17, 404).when(slot == 18, 500).when(~failed, 200).alias("status_code"),
        F.when(
            failed,
            F.element_at(
                F.array(F.lit("ConnectionError"), F.lit("Timeout"), F.lit("TooManyRedirects")), (i % 3 + 1).cast("int")
            ),
        ).alias("error_type"),
        F.when(failed, F.concat(F.lit("e"), i.cast("string"))).alias("error_message"),
        F.when(failed, "").otherwise(F.col("html")).alias("content"),
        F.when(
            i % 2 == 0, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("X-N"), i.cast("string"))
        )
        .otherwise(F.create_map(F.lit("Content-Type"), F.lit("text/html")))
        .alias("headers"),
        F.when(i % 10 == 0, F.array(F.concat(F.lit("http://r.example.com/"), i.cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("redirects"),
        ((i % 100) / 100.0).cast("double").alias("elapsed"),
        own_domain(F.col("url")).alias("target"),
        (i % 4).cast("int").alias("depth"),
    )


def start_urls(plain: DataFrame) -> DataFrame:
    """The first URL of every registered domain."""
    return plain.groupBy(own_domain(F.col("url")).alias("domain")).agg(F.min("url").alias("url")).select("url")
