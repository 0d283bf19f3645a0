"""DataFrame -> DataFrame operators on pages, lines, blocks and relations."""
