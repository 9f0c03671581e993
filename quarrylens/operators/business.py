"""Business-field resolution, the BI summary and the domain analyses."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require
from quarrylens.functions.dates import parse_timestamp
from quarrylens.ids import ROW_ID, data_columns, kind, numeric_columns
from quarrylens.operators.charts import build_bar_chart, build_line_chart
from quarrylens.operators.columns import bin_column
from quarrylens.operators.filters import filter_fields, slicer_values
from quarrylens.operators.ordered import Key, Ordered, attach_totals

# Business fields and the column names they answer to, first match wins.
ALIASES = {
    "sales": ["sales", "weekly sales", "net sales", "revenue", "amount", "sales amount", "total sales"],
    "profit": ["profit", "gross profit", "net profit"],
    "units": ["units sold", "units", "quantity", "volume"],
    "date": ["date", "order date", "transaction date", "week", "month"],
    "country": ["country", "geography", "region"],
    "product": ["product", "product name", "item"],
    "segment": ["segment", "customer segment", "category"],
    "store": ["store", "store id", "location", "location id"],
}


def _plain(name: str) -> str:
    return "".join(ch for ch in str(name).lower() if ch.isalnum())


def resolve_fields(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """Logical field to actual column, compared without case and punctuation."""
    available = {_plain(c): c for c in data_columns(df)}
    out = {}
    for field, names in aliases.items():
        hit = next((available[_plain(n)] for n in names if _plain(n) in available), None)
        if hit:
            out[field] = hit
    return out


def _number(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("double") if kind(df, column) == "numeric" else F.col(column).try_cast("double")


def _date(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("timestamp") if kind(df, column) == "datetime" else parse_timestamp(F.col(column))


def _filtered(df: DataFrame, fields: dict[str, str], filters) -> DataFrame:
    chosen = {fields[k]: v for k, v in (filters or {}).items() if k in fields}
    if "country" in (filters or {}) and "country" not in fields and "store" in fields:
        chosen[fields["store"]] = filters["country"]
    df = filter_fields(df, chosen)
    return df.withColumns({fields[f]: _number(df, fields[f]) for f in ("sales", "profit", "units") if f in fields})


def bi_kpis(df: DataFrame, filters=None) -> DataFrame:
    """One row: rows and whichever totals, margin, average and store count the fields allow."""
    f = resolve_fields(df)
    work = _filtered(df, f, filters)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name in ("sales", "profit", "units"):
        if name in f:
            aggs.append(F.sum(f[name]).alias(f"total_{name}"))
    if "sales" in f:
        aggs.append(F.avg(f["sales"]).alias("average_sales"))
    if "store" in f:
        aggs.append(F.count_distinct(F.col(f["store"]).cast("string")).alias("stores"))
    t = work.agg(*aggs)
    if "sales" in f and "profit" in f:
        t = t.withColumn("profit_margin_pct", F.try_divide(F.col("total_profit") * 100, F.col("total_sales")))
    return t


def top_table(df: DataFrame, dimension: str, measure: str, n: int = 10, name: str | None = None) -> DataFrame:
    """Largest groups by summed measure: bounded top-n over the grouped rows."""
    return df.filter(F.col(dimension).isNotNull() & F.col(measure).isNotNull()).groupBy(
        F.col(dimension).cast("string").alias(dimension)).agg(F.sum(measure).alias(name or measure)).orderBy(
        F.desc(name or measure), dimension).limit(n)


def build_bi_report(df: DataFrame, filters=None) -> dict[str, DataFrame]:
    """KPIs, charts, top tables and slicers as lazy frames over the filtered rows."""
    f = resolve_fields(df)
    work = _filtered(df, f, filters)
    out = {"kpis": bi_kpis(df, filters)}
    place = "country" if "country" in f else "store" if "store" in f else None
    if "sales" in f and place:
        out[f"sales_by_{place}"] = build_bar_chart(work, f[place], f["sales"], top_n=10)
        out[f"top_{'countries' if place == 'country' else 'stores'}"] = top_table(work, f[place], f["sales"])
    if "profit" in f and "product" in f:
        out["profit_by_product"] = build_bar_chart(work, f["product"], f["profit"], top_n=10)
        out["top_products"] = top_table(work, f["product"], f["profit"])
    if "sales" in f and "date" in f:
        out["sales_over_time"] = build_line_chart(work, f["date"], f["sales"], parse_datetime=True, frequency="MS",
                                                  fill_missing_intervals=True)
    slicers = [f[k] for k in ("country", "product", "segment", "store") if k in f]
    if slicers:
        out["slicers"] = slicer_values(df, slicers)
    return out


# ---------------------------------------------------------------- domain derivations

def rfm_segments(df: DataFrame, customer: str, date: str, amount: str, order_id: str | None = None) -> DataFrame:
    """Recency, frequency, monetary value and quartile segment per customer.

    Position in ascending monetary order (ties by customer) is the rank; the quartile is
    the smallest edge at or above it, edges being spaced evenly over 1..n.
    """
    when = _date(df, date)
    freq = F.count_distinct(order_id) if order_id else F.count(amount)
    g = df.groupBy(F.col(customer).alias("customer_id")).agg(
        F.max(when).alias("__last"), freq.alias("frequency"), F.sum(_number(df, amount)).alias("monetary_value"))
    g = attach_totals(g, [], __asof=F.max("__last"), __n=F.count(F.lit(1)))
    g = Ordered(g, [], [Key("monetary_value"), Key("customer_id")]).number("__rank").df
    q = F.least(F.lit(4), F.col("__n"))
    band = F.greatest(F.lit(1), F.ceil(F.coalesce(
        F.try_divide(q * (F.col("__rank") - 1).cast("double"), F.col("__n") - 1), F.lit(1.0))))
    labels = F.array(*[F.lit(x) for x in ("Bronze", "Silver", "Gold", "Platinum")])
    days = F.floor((F.unix_micros("__asof") - F.unix_micros("__last")) / 86_400_000_000)
    return g.select("customer_id", F.coalesce(days, F.lit(0)).alias("recency_days"), "frequency", "monetary_value",
                    F.lit(1).alias("customer_count"), F.element_at(labels, band.cast("int")).alias("rfm_segment"))


def conversion_rate(df: DataFrame, numerator: str, denominator: str, name: str = "conversion_rate") -> DataFrame:
    rate = F.try_divide(_number(df, numerator) * 100, _number(df, denominator))
    return df.withColumn(name, F.coalesce(rate, F.lit(0.0)))


def ab_lift(df: DataFrame, group: str, converted: str) -> DataFrame:
    """Rate of the second group minus the first, groups in value order."""
    g = df.groupBy(F.col(group).alias("g")).agg((F.avg(_number(df, converted)) * 100).alias("rate"))
    two = g.orderBy(F.col("g").asc_nulls_last()).limit(2)
    return two.agg(F.min_by("rate", "g").alias("control_rate"), F.max_by("rate", "g").alias("treatment_rate"),
                   F.count(F.lit(1)).alias("groups")).withColumn(
        "lift", F.when(F.col("groups") >= 2, F.col("treatment_rate") - F.col("control_rate")))


# Band edges (upper bounds, closed) and labels.
BANDS = {
    "credit_band": ([579, 669, 739, 799], ["Poor", "Fair", "Good", "Very good", "Excellent"]),
    "tenure_band": ([6, 12, 24, 48], ["0–6m", "7–12m", "13–24m", "25–48m", "49m+"]),
    "age_band": ([29, 44, 59, 74], ["18–29", "30–44", "45–59", "60–74", "75+"]),
}


def add_band(df: DataFrame, column: str, band: str) -> DataFrame:
    edges, labels = BANDS[band]
    inf = float("inf")
    return df.withColumn(band, bin_column(_number(df, column), [-inf, *map(float, edges), inf], labels,
                                          include_lowest=True))


def forecast_baseline(df: DataFrame, date: str, sales: str, order_column: str = ROW_ID, window: int = 3) -> DataFrame:
    """Mean of the last three rows in row order."""
    v = _number(df, sales)
    return Ordered(df, [], [Key(order_column)]).framed(
        window - 1, 0, forecast_baseline=lambda frame, w: F.avg(v).over(frame)).df


def inventory_metrics(df: DataFrame, closing: str | None = None, cost: str | None = None, sold: str | None = None,
                      opening: str | None = None, reorder: str | None = None) -> DataFrame:
    """Stock value with ABC class by cumulative share, stock-out flag, sell-through."""
    if closing and cost:
        df = df.withColumn("inventory_value", _number(df, closing) * _number(df, cost))
        df = abc_classes(df, "inventory_value")
    if closing and reorder:
        df = df.withColumn("stockout_risk", F.when(_number(df, closing) <= _number(df, reorder), 100).otherwise(0))
    if sold and opening:
        s = _number(df, sold)
        df = df.withColumn("sell_through_rate", F.coalesce(F.try_divide(s * 100, _number(df, opening) + s), F.lit(0.0)))
    return df


def abc_classes(df: DataFrame, value: str, tiebreak: str = ROW_ID, name: str = "abc_class") -> DataFrame:
    """A up to 80 %, B up to 95 % of the value accumulated from the largest down."""
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    work = attach_totals(df.withColumn("__v", v), [], __t=F.sum(v))
    o = Ordered(work, [], [Key("__v", ascending=False), Key(tiebreak)]).running(__c=("sum", F.col("__v")))
    share = F.col("__c") / F.greatest(F.col("__t"), F.lit(1.0))
    return o.df.withColumn(name, F.when(share <= 0.80, "A").when(share <= 0.95, "B").otherwise("C")).drop(
        "__v", "__t", "__c")


def returns_and_volatility(df: DataFrame, ticker: str, close: str, order_column: str = ROW_ID) -> DataFrame:
    """Relative change to the previous row of a ticker and its annualised deviation in percent."""
    v = _number(df, close)
    o = Ordered(df, [ticker], [Key(order_column)]).framed(1, 0, __p=lambda frame, w: F.lag(v, 1).over(w))
    t = o.df.withColumn("return", F.coalesce(F.try_divide(v, F.col("__p")) - 1, F.lit(0.0))).drop("__p")
    return attach_totals(t, [ticker], volatility=F.coalesce(F.stddev_pop("return") * (252 ** 0.5) * 100, F.lit(0.0)))


def marketing_roi(df: DataFrame, revenue: str, spend: str) -> DataFrame:
    s = _number(df, spend)
    return df.withColumn("marketing_roi", F.try_divide(_number(df, revenue) - s, s))


# ---------------------------------------------------------------- project specifications

def _spec(fields: dict, *charts) -> dict:
    return {"fields": fields, "charts": [dict(zip(("kind", "dimension", "measure"), c)) for c in charts]}


# Per domain the logical fields with their aliases and the charts to build.
PROJECTS = {
    "personal_expense_tracker": _spec(
        {"date": ["date", "transaction_date"], "category": ["category", "expense_category"],
         "amount": ["amount", "spend", "value"], "merchant": ["merchant", "payee"],
         "payment_method": ["payment_method", "method"]},
        ("bar", "category", "amount"), ("line", "date", "amount")),
    "superstore_sales_dashboard": _spec(
        {"date": ["date", "order_date"], "region": ["region", "country", "market"],
         "category": ["category", "product_category", "segment"], "sales": ["sales", "revenue", "sales_amount"],
         "profit": ["profit", "gross_profit"], "quantity": ["quantity", "units", "units_sold"]},
        ("line", "date", "sales"), ("bar", "region", "sales"), ("bar", "category", "profit")),
    "movie_ratings_exploration": _spec(
        {"title": ["title", "movie", "name"], "genre": ["genre", "genres", "category"],
         "rating": ["rating", "score", "imdb_rating"], "runtime": ["runtime", "runtime_minutes", "duration"],
         "year": ["release_year", "year", "release_date"]},
        ("bar", "genre", "rating"), ("line", "year", "rating")),
    "public_health_trend_analysis": _spec(
        {"date": ["date", "report_date"], "region": ["region", "state", "location"], "cases": ["cases", "case_count"],
         "deaths": ["deaths", "fatalities"], "vaccination": ["vaccination_rate", "vaccinated_pct", "coverage"]},
        ("line", "date", "cases"), ("bar", "region", "deaths")),
    "weather_pattern_analysis": _spec(
        {"date": ["date", "observation_date"], "city": ["city", "location"],
         "temperature": ["temperature_c", "temperature", "temp"],
         "rainfall": ["rainfall_mm", "rainfall", "precipitation"], "humidity": ["humidity", "humidity_pct"]},
        ("line", "date", "temperature"), ("bar", "city", "rainfall")),
    "media_catalog_analysis": _spec(
        {"title": ["title", "name", "track"], "content_type": ["type", "content_type", "media_type"],
         "genre": ["genre", "genres", "category"], "country": ["country", "market"],
         "release_year": ["release_year", "year"], "rating": ["rating", "score"],
         "duration": ["duration", "runtime", "minutes"]},
        ("bar", "genre", "rating"), ("line", "release_year", "duration")),
    "student_performance": _spec(
        {"student_id": ["student_id", "id"], "study_hours": ["study_hours", "study_time"],
         "math_score": ["math_score", "math"], "reading_score": ["reading_score", "reading"],
         "writing_score": ["writing_score", "writing"], "passed": ["passed", "pass", "outcome"],
         "parent_education": ["parent_education", "parental_level_of_education"]},
        ("bar", "parent_education", "math_score"), ("bar", "passed", "study_hours")),
    "ecommerce_funnel": _spec(
        {"date": ["date", "event_date"], "channel": ["channel", "source", "marketing_channel"],
         "visitors": ["visitors", "sessions"], "product_views": ["product_views", "views"],
         "add_to_cart": ["add_to_cart", "carts"], "checkout_started": ["checkout_started", "checkouts"],
         "purchases": ["purchases", "orders"], "revenue": ["revenue", "sales"]},
        ("line", "date", "visitors"), ("bar", "channel", "purchases")),
    "hr_attrition": _spec(
        {"employee_id": ["employee_id", "id"], "department": ["department", "team"],
         "overtime": ["overtime", "over_time"], "monthly_income": ["monthly_income", "income", "salary"],
         "tenure": ["years_at_company", "tenure", "tenure_years"],
         "attrition": ["attrition", "churned", "left_company"]},
        ("bar", "department", "attrition"), ("bar", "overtime", "monthly_income")),
    "customer_rfm_segmentation": _spec(
        {"customer_id": ["customer_id", "customer", "client_id"], "date": ["transaction_date", "date", "order_date"],
         "amount": ["amount", "revenue", "sales"], "order_id": ["order_id", "transaction_id"]},
        ("bar", "rfm_segment", "monetary_value"), ("bar", "rfm_segment", "customer_count")),
    "ab_test_analysis": _spec(
        {"visitor_id": ["visitor_id", "user_id"], "experiment_group": ["group", "variant", "experiment_group"],
         "converted": ["converted", "conversion", "is_converted"], "revenue": ["revenue", "value", "sales"]},
        ("bar", "experiment_group", "converted"), ("bar", "experiment_group", "revenue")),
    "website_traffic_dashboard": _spec(
        {"date": ["date", "event_date"], "source": ["source", "channel", "traffic_source"],
         "sessions": ["sessions", "visitors"], "bounce_rate": ["bounce_rate", "bounce_pct"],
         "conversions": ["conversions", "purchases"], "pageviews": ["pageviews", "views"]},
        ("line", "date", "sessions"), ("bar", "source", "conversions")),
    "loan_default_risk": _spec(
        {"loan_id": ["loan_id", "id"], "income": ["income", "annual_income"], "loan_amount": ["loan_amount", "amount"],
         "credit_score": ["credit_score", "score"], "defaulted": ["defaulted", "default", "loan_default"],
         "purpose": ["purpose", "loan_purpose"]},
        ("bar", "purpose", "defaulted"), ("bar", "credit_band", "loan_amount")),
    "sales_forecasting": _spec(
        {"date": ["date", "month", "order_date"], "region": ["region", "market"],
         "sales": ["sales", "revenue", "amount"]},
        ("line", "date", "sales"), ("bar", "region", "sales")),
    "customer_churn_prediction": _spec(
        {"customer_id": ["customer_id", "id"], "tenure": ["tenure_months", "tenure"],
         "monthly_charges": ["monthly_charges", "charges"], "support_tickets": ["support_tickets", "tickets"],
         "contract": ["contract", "plan"], "churned": ["churned", "churn", "attrition"]},
        ("bar", "contract", "churned"), ("bar", "tenure_band", "monthly_charges")),
    "fraud_detection": _spec(
        {"transaction_id": ["transaction_id", "id"], "date": ["date", "transaction_date"],
         "merchant_category": ["merchant_category", "category"], "amount": ["amount", "transaction_amount"],
         "country": ["country", "region"], "is_fraud": ["is_fraud", "fraud", "label"]},
        ("bar", "merchant_category", "is_fraud"), ("line", "date", "amount")),
    "supply_chain_inventory": _spec(
        {"date": ["date", "snapshot_date"], "sku": ["sku", "sku_id", "product_id"],
         "product_name": ["product_name", "product"], "category": ["category", "product_category"],
         "warehouse": ["warehouse", "location"], "opening_stock": ["opening_stock", "opening"],
         "purchases": ["purchases", "receipts"], "units_sold": ["units_sold", "quantity_sold"],
         "closing_stock": ["closing_stock", "ending_stock"], "unit_cost": ["unit_cost", "cost"],
         "unit_price": ["unit_price", "price"], "reorder_level": ["reorder_level", "reorder_point"]},
        ("bar", "category", "inventory_value"), ("bar", "warehouse", "stockout_risk"),
        ("bar", "abc_class", "inventory_value")),
    "stock_market_volatility": _spec(
        {"date": ["date", "trade_date"], "ticker": ["ticker", "symbol"], "close": ["close", "close_price", "price"],
         "volume": ["volume", "trade_volume"]},
        ("line", "date", "close"), ("bar", "ticker", "volatility")),
    "healthcare_outcomes": _spec(
        {"patient_id": ["patient_id", "id"], "age": ["age", "patient_age"], "glucose": ["glucose", "blood_glucose"],
         "bmi": ["bmi", "body_mass_index"], "blood_pressure": ["blood_pressure", "bp"],
         "outcome": ["outcome", "diagnosis", "diabetes"]},
        ("bar", "outcome", "glucose"), ("bar", "age_band", "bmi")),
    "end_to_end_capstone": _spec(
        {"date": ["date", "event_date"], "region": ["region", "market"], "channel": ["channel", "source"],
         "revenue": ["revenue", "sales"], "marketing_spend": ["marketing_spend", "spend", "ad_spend"],
         "orders": ["orders", "order_count"], "nps": ["nps", "satisfaction", "score"],
         "customer_id": ["customer_id", "customer"]},
        ("line", "date", "revenue"), ("bar", "channel", "revenue"), ("bar", "region", "nps")),
}

# Measures that bars average (all others are summed), and the order in which a
# domain's fields are tried as its main measure.
AVERAGED = ("rating", "temperature", "humidity", "bounce_rate", "nps", "volatility")
MAIN_MEASURES = ("revenue", "sales", "profit", "amount", "monetary_value", "cases", "purchases", "conversions",
                 "sessions", "visitors", "loan_amount", "monthly_income", "close", "rating", "temperature", "glucose",
                 "bmi", "inventory_value", "nps")


def prepare_project(df: DataFrame, project: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with the domain's derived columns, and its resolved fields."""
    require(project in PROJECTS, "UNKNOWN_PROJECT", project=project)
    given = df.columns
    f = resolve_fields(df, PROJECTS[project]["fields"])

    def have(*names):
        return all(n in f for n in names)

    if project == "customer_rfm_segmentation":
        require(have("customer_id", "date", "amount"), "FIELDS_REQUIRED")
        df = rfm_segments(df, f["customer_id"], f["date"], f["amount"], f.get("order_id"))
        f = {c: c for c in df.columns}
    elif project == "ecommerce_funnel" and have("purchases", "visitors"):
        df = conversion_rate(df, f["purchases"], f["visitors"])
    elif project == "website_traffic_dashboard" and have("conversions", "sessions"):
        df = conversion_rate(df, f["conversions"], f["sessions"])
    elif project == "loan_default_risk" and have("credit_score"):
        df = add_band(df, f["credit_score"], "credit_band")
    elif project == "customer_churn_prediction" and have("tenure"):
        df = add_band(df, f["tenure"], "tenure_band")
    elif project == "healthcare_outcomes" and have("age"):
        df = add_band(df, f["age"], "age_band")
    elif project == "sales_forecasting" and have("date", "sales"):
        df = forecast_baseline(df, f["date"], f["sales"])
    elif project == "supply_chain_inventory":
        df = inventory_metrics(df, f.get("closing_stock"), f.get("unit_cost"), f.get("units_sold"),
                               f.get("opening_stock"), f.get("reorder_level"))
    elif project == "stock_market_volatility" and have("date", "ticker", "close"):
        df = returns_and_volatility(df, f["ticker"], f["close"])
    elif project == "end_to_end_capstone" and have("revenue", "marketing_spend"):
        df = marketing_roi(df, f["revenue"], f["marketing_spend"])
    derived = {c: c for c in df.columns if c not in given and c != ROW_ID}
    return df, {**derived, **f}


def detail_table(df: DataFrame, dimension: str, measure: str, n: int = 12) -> DataFrame:
    v = _number(df, measure)
    return df.filter(F.col(dimension).isNotNull() & v.isNotNull()).groupBy(dimension).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean")).orderBy(
        F.desc("sum"), dimension).limit(n)


def main_measure(df: DataFrame, fields: dict[str, str]) -> str:
    """The first field of ``MAIN_MEASURES`` with a number in it, else the first number column.
    One pass counts the numbers of all candidates."""
    tried = [fields[m] for m in MAIN_MEASURES if m in fields]
    if tried:
        counts = df.agg(*[F.count(_number(df, c)).alias(f"n{i}") for i, c in enumerate(tried)]).first()
        hit = next((c for i, c in enumerate(tried) if counts[i]), None)
        if hit:
            return hit
    first = next(iter(numeric_columns(df)), None)
    require(first is not None, "NO_MEASURE")
    return first


def driver_chart(df: DataFrame, dimension: str, measure: str, n: int = 24) -> DataFrame:
    """Sums of a measure over the first ``n`` values of a dimension."""
    v = _number(df, measure)
    work = df.select(F.col(dimension), v.alias("__v")).dropna()
    return work.groupBy(dimension).agg(F.sum("__v").alias("value")).orderBy(dimension).limit(n)


def trend_chart(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """Sums by month, months without rows being 0. A dimension of plain numbers (a year) keeps
    its numbers as points; a text column without a date in it is summed by its own values."""
    work = df.withColumn(measure, _number(df, measure))
    what = kind(work, dimension)
    if what == "numeric":
        return build_line_chart(work, dimension, measure)
    if what != "datetime" and work.filter(_date(work, dimension).isNotNull() & F.col(measure).isNotNull()).isEmpty():
        return driver_chart(work, dimension, measure)
    return build_line_chart(work, dimension, measure, parse_datetime=True, frequency="MS", fill_missing_intervals=True)


def build_project(df: DataFrame, project: str) -> dict[str, DataFrame]:
    """KPIs, chart rows and detail tables of one domain.

    Bars sum their measure over the twelve largest categories, or average it where it is one of
    ``AVERAGED``; lines sum by month with gaps filled. A domain of which fewer than two charts
    can be made gets ``chart_driver``, the first number column by the first field that is none.
    Without any detail table, ``detail_sample`` holds twenty values of the main measure.
    """
    frame, f = prepare_project(df, project)
    spec = PROJECTS[project]
    measure = main_measure(frame, f)
    v = _number(frame, measure)
    kpi = [F.count(F.lit(1)).alias("rows"), F.sum(v).alias("total"), F.avg(v).alias("average")]
    if "conversion_rate" in f:
        kpi.append(F.avg("conversion_rate").alias("conversion_rate"))
    if "rfm_segment" in f:
        kpi.append(F.count_distinct("rfm_segment").alias("customer_segments"))
    out = {"kpis": frame.agg(*kpi)}
    if project == "ab_test_analysis" and "experiment_group" in f and "converted" in f:
        out["lift"] = ab_lift(frame, f["experiment_group"], f["converted"])
    charts = [(i, c) for i, c in enumerate(spec["charts"], 1) if c["dimension"] in f and c["measure"] in f]
    for i, c in charts:
        d, m = f[c["dimension"]], f[c["measure"]]
        if c["kind"] == "line":
            out[f"chart_{i}"] = trend_chart(frame, d, m)
        else:
            how = "mean" if c["measure"] in AVERAGED else "sum"
            out[f"chart_{i}"] = build_bar_chart(frame.withColumn(m, _number(frame, m)), d, m, aggregation=how, top_n=12)
    shown = [(f[c["dimension"]], f[c["measure"]]) for _, c in charts]
    if len(charts) < 2:
        named = next((c for c in f.values() if kind(frame, c) != "numeric"), None)
        number = next(iter(numeric_columns(frame)), None)
        if named and number:
            out["chart_driver"] = driver_chart(frame, named, number)
            shown.append((named, number))
    for k, (d, m) in enumerate(shown[:2], 1):
        out[f"detail_{k}"] = detail_table(frame, d, m)
    if not shown:
        out["detail_sample"] = frame.select(v.alias(measure)).dropna().limit(20)
    return out
