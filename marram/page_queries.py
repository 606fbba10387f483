"""Queries over pages: elements with their nesting, cleaning, whole records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions import pages, text
from marram.queries import query, table

SCRIPTLESS = r"regexp_replace(regexp_replace(html, '(?s)(<script[^>]*>).*?</script>', '\1', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS items, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages""")
def page_elements(spark, sf):
    """The menu with all that is nested in it, the items, and an article whose paragraphs and bold spans aren't all closed."""
    html = F.col("html")
    first = lambda *a: F.get(pages.elements(html, *a), F.lit(0))
    return table(spark, sf, "pages").select("page_id", first("nav").alias("nav"), F.size(pages.elements(html, "li")).alias("items"), first("div", "class", "ad", "word").alias("ad"), first("article").alias("article"))


@query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all({SCRIPTLESS}, '<([a-z0-9]+)', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n, CAST(CASE tag WHEN 'html' THEN 0 WHEN 'body' THEN 1 WHEN 'head' THEN 1 WHEN 'title' THEN 2 WHEN 'nav' THEN 2 WHEN 'ul' THEN 3 WHEN 'li' THEN 4 WHEN 'a' THEN 5 WHEN 'article' THEN 2 ELSE -1 END AS INTEGER) AS depth
    FROM t GROUP BY page_id, tag""")
def page_outline(spark, sf):
    """Elements of each page by tag, and how deep those of the page's frame stand."""
    nodes = pages.page_nodes(table(spark, sf, "pages"), "page_id", "html").filter("tag <> '#comment'")
    framed = F.col("tag").isin("html", "head", "title", "body", "nav", "ul", "li", "a", "article")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.when(F.min(framed), F.max("depth")).otherwise(-1).alias("depth"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script\b.*?</script>|<!--.*?-->|<div class="ad">.*?</div>|<nav id="menu">.*?</nav>', '', 'g'), '>\s+<', '><', 'g') AS html
    FROM (SELECT page_id, replace(replace(html, '<nav>', '<nav id="menu">'), '</li>', E'</li>\n ') AS html FROM pages)""")
def clean_pages(spark, sf):
    """Pages without scripts, comments, advertisements and the menu, whose lists go with it."""
    html = F.replace(F.replace("html", F.lit("<nav>"), F.lit('<nav id="menu">')), F.lit("</li>"), F.lit("</li>\n "))
    return table(spark, sf, "pages").select("page_id", pages.clean_page(html, ("menu",), ("ad",)).alias("html"))


@query("""SELECT page_id, 'Name' || page_id || ' Inner' AS author, CAST(NULL AS VARCHAR) AS publisher, 'Роман, Проза' AS genre, 64 * (1 + page_id % 4) || ' kbps' AS bitrate, (10 + page_id % 50) || ' мин.' AS length,
    CAST((page_id % 50 + 0.5) * 1048576 AS BIGINT) AS size_bytes FROM pages""")
def catalogue_pages(spark, sf):
    """Pages with a record in a nested element, its keys in several spellings, as records with sizes."""
    n = F.col("page_id")
    body = F.concat(
        F.lit("<div class='full'><div id='other'>Жанр: no</div><div id='news-id-"), n, F.lit("'><b>Title: x</b><br>..-Авторы: first<br>Жанр: РОМАН,проза<br>Автор: name"), n, F.lit(" <i>inner</i><!-- Автор: c --><br>Битрейт: "),
        64 * (1 + n % 4), F.lit(" kbps<br>Жанр:роман,ПРОЗА<br>Доп. информация: Время: "), 10 + n % 50, F.lit(" мин.<br><div>\n</div><table><tr class='row1'><td>Общий размер:</td>\n<td>&nbsp;<b>"), n % 50, F.lit(",5 Мб</b></td></tr></table></div></div>"), "html",
    )
    found = pages.parsed_records(table(spark, sf, "pages").select("page_id", body.alias("html")), "page_id", "html", F.get(pages.elements(F.col("html"), "div", "id", "news-id-", "prefix"), F.lit(0)), "table")
    return found.select("page_id", "author", "publisher", "genre", "bitrate", "length", "size_bytes")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Second Name' ELSE 'First Name' END AS author, 'Publisher ' || page_id AS publisher, '05:' || (10 + page_id % 50) AS length, 'Long "text"' AS description FROM pages""")
def forum_pages(spark, sf):
    """Posts as records: of synonyms the one that begins last on the page counts, with its own last value."""
    n = F.col("page_id")
    key = lambda name, value: F.concat(F.lit(f'<span class="post-b">{name}</span>: '), value)
    one, two = key("Автор", F.lit("<b>first</b> name")), key("Авторы", F.lit("x"))
    order = F.when(n % 2 == 0, F.concat(one, F.lit("<br>"), key("Авторы", F.lit("<i>second</i> name")))).otherwise(F.concat(two, F.lit("<br>"), one))
    body = F.concat(F.lit('<div class="post_body"><var class="img">y</var>'), order, F.lit("<br>"), key("Издательство", F.concat(F.lit("publisher "), n)), F.lit('<hr class="post-hr">'), key("Время", F.concat(F.lit("05:"), 10 + n % 50)), key("Описание", F.lit('Long <span class="post-b">"text"</span>')), F.lit("</div>"), "html")
    found = pages.parsed_records(table(spark, sf, "pages").select("page_id", body.alias("html")), "page_id", "html", F.get(pages.elements(F.col("html"), "div", "class", "post_body"), F.lit(0)))
    return found.select("page_id", "author", "publisher", "length", "description")


@query(r"""SELECT page_id, CAST(greatest(1, page_id) AS INTEGER) AS n_pages, 'magnet:?xt=urn:' || page_id AS magnet, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS topic FROM pages""")
def page_links(spark, sf):
    """Page counts, magnet links and topics' ids from links that are put behind each page."""
    html = F.concat("html", F.lit("<a href='x'> "), "page_id", F.lit("</a><a href=\"y\">next</a><a title='t' href='magnet:?xt=urn:"), "page_id", F.lit("'>m</a>"))
    return table(spark, sf, "pages").select("page_id", text.page_count(html).alias("n_pages"), text.magnet(html).alias("magnet"), text.last_segment(F.col("url")).alias("topic"))
