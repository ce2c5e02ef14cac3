"""The jobs as queries: two runs over the whole tables into a new folder, and the output after the second."""

from jobs import snapshot_catalogs, text_spectra

QUERIES = {"job1_snapshot_catalogs": snapshot_catalogs.job1_snapshot_catalogs, "job2_text_spectra": text_spectra.job2_text_spectra}
SQL = {"job1_snapshot_catalogs": snapshot_catalogs.SQL, "job2_text_spectra": text_spectra.SQL}
