"""Identity-aware substitution: e-mail addresses, phone numbers, names, usernames, hosts and home paths.

``live`` runs e-mails, phones, names, then for each username user@host, ~user, home paths and the plain name, then
hosts. ``lib`` runs home paths last, gated by their own flag, and labels events more finely.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.events import Stage, apply, event, state, when_found
from velum.functions.regex import IGNORE_CASE, B, hits, quote, replace_all, rewrite, word_start
from velum.operators import dictionary
from velum.operators.dictionary import Mapping

# Mail domains of consumers.
CONSUMER_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "msn.com", "icloud.com", "me.com", "mac.com", "aol.com", "proton.me", "protonmail.com", "mail.com", "zoho.com", "fastmail.com", "yandex.com", "gmx.com", "gmx.net", "comcast.net", "verizon.net", "att.net", "cox.net", "sbcglobal.net", "charter.net", "bellsouth.net")
EMAIL = rf"(?=[a-zA-Z0-9._%+\-]){B}[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{B}"
EMAIL_PART = r"@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2}"
CATCH_ALL = "user@example.com"


@dataclass(frozen=True)
class Identity:
    """Pairs (real, substitute); names also have a type: first, last, middle or nick. A family runs unless its flag is
    exactly False."""

    emails: tuple = ()
    names: tuple = ()
    usernames: tuple = ()
    hostnames: tuple = ()
    phones: tuple = ()
    catch_all_email: str | None = None
    email_domains: tuple = ()
    enabled: dict = field(default_factory=dict)

    def on(self, family: str) -> bool:
        return self.enabled.get(family) is not False

    def configured(self) -> set[str]:
        """All real and substitute values, in lower case."""
        return {x.lower() for family in (self.names, self.emails, self.usernames, self.hostnames, self.phones) for row in family for x in row[:2] if x}


def merge_profiles(profiles: list[dict]) -> Identity:
    """One identity from the active profiles: their pairs in order, and the first catch-all address that isn't empty."""
    active = [p for p in profiles if p.get("active")]
    join = lambda k: tuple(tuple(x) if isinstance(x, (list, tuple)) else x for p in active for x in p.get(k) or ())
    return Identity(join("emails"), join("names"), join("usernames"), join("hostnames"), join("phones"), next((p["catch_all_email"] for p in active if p.get("catch_all_email")), None), join("email_domains"))


def _emails(text: Column, identity: Identity) -> Column:
    known = {real.lower(): substitute for real, substitute in identity.emails}
    domains = [*CONSUMER_DOMAINS, *(d.lower() for d in identity.email_domains)]
    catch_all = F.lit(identity.catch_all_email or CATCH_ALL)

    def new(match: Column) -> Column:
        low = F.lower(match)
        out = F.when(F.element_at(F.split(low, "@"), 2).isin(domains), catch_all)
        if known:
            out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), low), out)
        return F.when(out != "", out)

    def found() -> Column:
        made = F.transform(hits(text, EMAIL), lambda m: event(m, new(m), "email", "smart"))
        events = F.reverse(F.filter(made, lambda e: e["replaced"].isNotNull()))
        return state(rewrite(text, EMAIL, lambda m: F.coalesce(new(m), m)), events)

    return when_found(text, EMAIL, found, needs="@", part=EMAIL_PART)


def _rule(text: Column, pattern: str, new, category: str, label: str) -> Column:
    """One pattern whose matches become ``new(match)``, an event for each."""
    found = lambda: state(rewrite(text, pattern, new), F.transform(hits(text, pattern), lambda m: event(m, new(m), category, label)))
    return when_found(text, pattern, found)


def phone_pattern(real: str) -> str | None:
    """Seven or ten digits (a leading 1 of eleven is dropped) with the usual separators."""
    digits = re.sub(r"\D", "", real)
    if digits.startswith("1") and len(digits) == 11:
        digits = digits[1:]
    gap = r"[\s.\-]?"
    if len(digits) == 10:
        a, b, c = digits[:3], digits[3:6], digits[6:]
        return rf"(?:\+?1[\s.-]?)?(?:{a}|\({a}\)){gap}{b}{gap}{c}"
    return f"{digits[:3]}{gap}{digits[3:]}" if len(digits) == 7 else None


def _possessive(match: Column, substitute: str) -> Column:
    return F.when(match.endswith("'s"), F.lit(substitute + "'s")).otherwise(F.lit(substitute))


def _at_host(match: Column, user: str, substitute: str, hosts: dict[str, str]) -> Column:
    host = F.substr(match, F.lit(len(user) + 2))
    if hosts:
        host = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv]), F.lower(host)), host)
    return F.concat(F.lit(substitute + "@"), host)


def _home(match: Column, user: str, substitute: str) -> Column:
    return F.concat(F.substr(match, F.lit(1), F.length(match) - len(user)), F.lit(substitute))


def stages(identity: Identity, variant: str = "live") -> list[Stage]:
    lib = variant == "lib"
    label = lambda fine: fine if lib else "smart"
    out: list[Stage] = []
    add = lambda pattern, new, category, fine: out.append(partial(_rule, pattern=pattern, new=new, category=category, label=label(fine)))
    constant = lambda s: lambda m: F.lit(s)
    if identity.on("emails"):
        out.append(partial(_emails, identity=identity))
    if identity.on("phones"):
        for real, substitute in identity.phones:
            if real and substitute and (pattern := phone_pattern(real)):
                add(pattern, constant(substitute), "phone", "smart")
    if identity.on("names"):
        firsts = [n for n in identity.names if n[2] == "first"]
        lasts = [n for n in identity.names if n[2] == "last"]
        for first in firsts:
            for last in lasts:
                add(rf"{IGNORE_CASE}{quote(first[0])}\s+{quote(last[0])}", constant(f"{first[1]} {last[1]}"), "name", "smart-fullname")
                add(rf"{IGNORE_CASE}{quote(last[0])},\s*{quote(first[0])}", constant(f"{last[1]}, {first[1]}"), "name", "smart-fullname-reverse")
        for real, substitute, _ in identity.names:
            if real and substitute:
                add(f"{IGNORE_CASE}{word_start(real)}(?:'s)?{B}", partial(_possessive, substitute=substitute), "name", "smart-name")
    hosts = {real.lower(): (real, substitute) for real, substitute in identity.hostnames if real and substitute}
    users = [(u, s) for u, s in identity.usernames if u and s]

    def paths(u: str, s: str) -> None:
        add(rf"/(?:home|Users)/{quote(u)}(?=/|\s|\z|\"|')", partial(_home, user=u, substitute=s), "path", "smart-path-unix")
        add(rf"(?i)[A-Z]:\\Users\\{quote(u)}(?=\\|\s|\z|\"|')", partial(_home, user=u, substitute=s), "path", "smart-path-windows")

    if identity.on("usernames"):
        swap = {k: s for k, (_, s) in hosts.items()}
        for u, s in users:
            add(rf"{quote(u)}@[a-zA-Z0-9._\-]+", partial(_at_host, user=u, substitute=s, hosts=swap), "username", "smart-userhost")
            add(f"~{quote(u)}{B}", constant("~" + s), "username", "smart-tilde")
            if not lib:
                paths(u, s)
            if len(u) >= 3:
                add(f"{word_start(u)}{B}", constant(s), "username", "smart-username")
        for real, substitute in hosts.values():
            if len(real) >= 3:
                add(f"{IGNORE_CASE}{word_start(real)}{B}", constant(substitute), "hostname", "smart-hostname")
    if lib and identity.on("paths"):
        for u, s in users:
            paths(u, s)
    return out


def merged_profiles(profiles: DataFrame, by: list[str], ordinal: str, families: list[str]) -> DataFrame:
    """The same for tables of profiles (active, catch_all_email, arrays of pairs), for each of ``by``: one row with the
    arrays of the active ones joined in their order, and their first catch-all address."""
    active = profiles.where("active")
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, F.coalesce(f, F.array().cast(profiles.schema[f].dataType)).alias("rows")))), lambda r: r["rows"])).alias(f) for f in families]
    first = F.min_by("catch_all_email", F.when(F.col("catch_all_email") != "", F.col(ordinal)))
    return active.groupBy(*by).agg(*joined, first.alias("catch_all_email"))


def substitute(docs: DataFrame, identity: Identity, text_col: str = "text", result_col: str = "result", variant: str = "live") -> DataFrame:
    """``docs`` with struct<text, events> in ``result_col``."""
    return apply(docs, text_col, stages(identity, variant), result_col)


def reveal(text: Column, mappings: Iterable[Mapping], identity: Identity) -> Column:
    """The text turned back by configuration alone: dictionary rules, then the identity's pairs, in any case; the
    catch-all address, which stands for many, becomes ``[catch-all]``."""
    text = dictionary.reveal(text, mappings)
    pairs = [row[:2] for family in (identity.emails, identity.names, identity.usernames, identity.hostnames, identity.phones) for row in family if row[0] and row[1]]
    for real, substitute_ in sorted(pairs, key=lambda p: -len(p[1])):
        text = replace_all(text, IGNORE_CASE + quote(substitute_), real)
    if identity.catch_all_email:
        text = replace_all(text, IGNORE_CASE + quote(identity.catch_all_email), "[catch-all]")
    return text


def missing_fields(identity: Identity) -> list[str]:
    """What a complete identity still needs."""
    has = lambda rows: any(r[0] and r[1] for r in rows)
    checks = [("first name", has(n for n in identity.names if n[2] == "first")), ("last name", has(n for n in identity.names if n[2] == "last")), ("email or catch-all", has(identity.emails) or bool(identity.catch_all_email)), ("username", has(identity.usernames))]
    return [name for name, ok in checks if not ok]


__all__ = ["Identity", "merge_profiles", "merged_profiles", "missing_fields", "reveal", "stages", "substitute"]
