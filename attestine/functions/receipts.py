"""Receipts: the page that was cited, made safe, with a banner and the place of the quote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestine.functions.pages import sanitize
from attestine.functions.tokens import let

STYLE = "#receipt{position:sticky;top:0;background:#fff;border-bottom:2px solid #264;padding:.5em;font:14px sans-serif}"
SCRIPT = "window.receiptAnchor=%s;"
POLICY = "default-src 'none'; img-src data:; style-src 'unsafe-inline'; script-src 'unsafe-inline'"


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def anchor_json(anchor: Column) -> Column:
    """The anchor as JSON that can't end the script it stands in."""
    fields = F.to_json(F.struct(*[F.coalesce(anchor[k], F.lit("")).alias(k) for k in ("exact", "prefix", "suffix", "strategy")]))
    for raw, safe in (("</", "<\\/"), (" ", "\\u2028"), (" ", "\\u2029")):
        fields = F.replace(fields, F.lit(raw), F.lit(safe))
    return fields


def banner(claim: Column, url: Column, verdict: Column, tactic: Column, sha256: Column) -> Column:
    via = F.when(F.coalesce(tactic, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" via "), escape(tactic)))
    return F.concat(
        F.lit('<div id="receipt"><div class="claim">'), escape(claim), F.lit('</div><div class="source">source: '), escape(url), F.lit(" &middot; verdict "), escape(verdict), via,
        F.lit(" &middot; snapshot sha256 "), F.left(sha256, F.lit(16)), F.lit("&hellip;</div></div>"),
    )


def render(page: Column, claim: Column, url: Column, verdict: Column, tactic: Column, sha256: Column, anchor: Column) -> Column:
    """The sanitised page with the banner after its <body> tag, or before everything if it has none."""
    before, after = SCRIPT.split("%s")
    inset = F.concat(F.lit(f"<style>{STYLE}</style>"), banner(claim, url, verdict, tactic, sha256), F.lit(f"<script>{before}"), anchor_json(anchor), F.lit(f"{after}</script>"))
    return let(sanitize(page), lambda safe: let(F.instr(F.lower(safe), "<body"), lambda tag: _inset(safe, inset, tag)))


def _inset(safe: Column, inset: Column, tag: Column) -> Column:
    shut = tag + F.instr(F.substring(safe, tag, F.length(safe)), ">") - 1
    return F.when((tag > 0) & (shut >= tag), F.concat(F.left(safe, shut), inset, F.substring(safe, shut + 1, F.length(safe)))).otherwise(F.concat(inset, safe))
