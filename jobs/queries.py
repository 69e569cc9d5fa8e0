"""The jobs as registered queries."""

from jobs import terms, tiles

QUERIES = {"job1_mass_tiles": tiles.job1_mass_tiles, "job2_terms": terms.job2_terms}
SQL = {"job1_mass_tiles": tiles.SQL, "job2_terms": terms.SQL}
