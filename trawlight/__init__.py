"""Search-style analytics on Spark: pages, links, crawl order, full-text ranking, result merging."""
