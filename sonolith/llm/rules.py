"""Production rules of the URL filter query."""

from .urlfilter import PatternRule, SiteRule

SITE_RULES = [
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
]

PATTERN_RULES = [
    PatternRule("^casino-win^"), PatternRule("^free-bets^"), PatternRule("^cheap-pills^"), PatternRule("^ads-track^"),
    PatternRule("^casino^"), PatternRule("^poker^"), PatternRule("^viagra^"), PatternRule("^xxx^"), PatternRule("^adserver^"),
    PatternRule("^utm_campaign=spam^"), PatternRule("^login^*^redirect^"), PatternRule("^robots.txt^", "allow"),
]
