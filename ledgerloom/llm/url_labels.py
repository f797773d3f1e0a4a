"""A small table of labelled URLs, built from words by a rule.

Sites to read and sites to leave out, under every top-level domain alike, so that a
domain's ending says nothing about a verdict.  Two of three URLs are allowed.
"""

from __future__ import annotations

#: Top-level domains, words of hosts, what stands around them, and paths.
DOMAINS = ("com", "net", "org", "de", "fr", "es")
READ = (
    "library", "museum", "journal", "science", "history", "garden", "weather", "recipe", "school",
    "travel", "physics", "music",
)
LEAVE = (
    "casino", "poker", "jackpot", "betting", "lottery", "slots", "escort", "cheappills", "payday",
    "warez", "keygen", "replica",
)
AROUND = ("{}", "my{}", "{}online", "{}24", "best{}", "{}-world", "the{}", "{}hub", "new{}", "{}city")
PREFIXES = ("", "www.", "blog.", "m.")
READ_PATHS = (
    "/en/article/{}", "/{}.html", "/docs/guide/{}", "/2021/05/story-{}", "/de/{}/", "/es/{}", "/fr/{}.html",
    "/topics/{}", "/",
)
LEAVE_PATHS = ("/bonus/free-{}", "/en/win/{}", "/click/offer{}", "/download/crack-{}", "/signup?ref={}", "/de/deal/{}")


def labelled_urls() -> list[tuple[str, str]]:
    """`(url, verdict)`: for each domain, each word to read twice and each to leave out once."""
    found = []
    for d, domain in enumerate(DOMAINS):
        for verdict, words, paths, turns in (("allow", READ, READ_PATHS, 2), ("block", LEAVE, LEAVE_PATHS, 1)):
            for w, word in enumerate(words):
                for turn in range(turns):
                    place = 7 * d + 3 * w + 5 * turn
                    host = PREFIXES[place % len(PREFIXES)] + AROUND[place % len(AROUND)].format(word)
                    path = paths[place % len(paths)].format(1000 + 37 * place)
                    found.append((f"https://{host}.{domain}{path}", verdict))
    return found
