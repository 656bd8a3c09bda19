from . import arxiv, europe_pmc  # noqa: F401  (they register themselves)
