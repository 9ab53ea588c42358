"""Contacts per site."""

from contactline.operators import contacts as ct


def test_a_url_of_many_rows_is_looked_at_once(spark, monkeypatch):
    looked_at = []

    def noted(df, name):
        looked_at.append((name, df.count()))
        return df

    monkeypatch.setattr(ct, "materialise", noted)
    urls = ["https://a.oak.co.uk/x", "https://oak.co.uk/", "elm.org", "", None]
    rows = [(f"s{i % 2}", urls[i % 5]) for i in range(200)]
    pages = spark.createDataFrame(rows, "site_key string, url string")
    found = {tuple(r) for r in ct.site_domains(pages).collect()}
    assert found == {(s, d) for s in ("s0", "s1") for d in ("oak.co.uk", "elm.org")}
    assert looked_at == [("site_urls", 10)]
