"""The shop tables of a migration: a few rows with typed, awkward values."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D


def departments(spark):
    rows = [
        (1, "Engineering", "ENG", D("500000.00")),
        (2, "Sales", "SAL", D("350000.00")),
        (3, "Marketing", "MKT", D("250000.00")),
        (4, "Human Resources", "HR", D("150000.00")),
        (5, "Finance", "FIN", D("200000.00")),
    ]
    return spark.createDataFrame(rows, "department_id int, department_name string, department_code string, budget decimal(15,2)")


def employees(spark):
    rows = [
        (100, "John", "Smith", "+1-555-0101", date(2020, 1, 15), D("95000.0000"), 1, None),
        (101, "Sarah", "Johnson", "+1-555-0102", date(2020, 3, 20), D("85000.0000"), 1, 100),
        (102, "Michael", "Williams", "+1-555-0103", date(2019, 6, 1), D("78000.0000"), 2, None),
        (103, "Emily", "Brown", None, date(2021, 2, 14), D("72000.0000"), 2, 102),
        (104, "David", "Davis", "+1-555-0105", date(2018, 11, 30), D("110000.0000"), 1, 100),
        (105, "Jessica", "Miller", "+1-555-0106", date(2022, 4, 10), D("65000.0000"), 3, None),
    ]
    return spark.createDataFrame(
        rows,
        "employee_id int, first_name string, last_name string, phone string, hire_date date, salary decimal(19,4), "
        "department_id int, manager_id int",
    )


def categories(spark):
    rows = [
        (1, "Electronics", None),
        (2, "Computers", 1),
        (3, "Laptops", 2),
        (4, "Desktops", 2),
        (5, "Mobile Devices", 1),
        (6, "Home & Garden", None),
        (7, "Furniture", 6),
        (8, "Kitchen", 6),
    ]
    return spark.createDataFrame(rows, "category_id int, category_name string, parent_category_id int")


def orders(spark):
    rows = [
        (10000, 1, 102, datetime(2024, 1, 15, 9, 30), D("1299.9900"), D("104.0000"), D("0.0000"), "Delivered"),
        (10001, 2, 103, datetime(2024, 1, 18, 11, 15), D("2199.9800"), D("175.9900"), D("50.0000"), "Delivered"),
        (10002, 1, 102, datetime(2024, 2, 1, 14, 45), D("899.9900"), D("72.0000"), D("0.0000"), "Processing"),
        (10003, 3, 103, datetime(2024, 2, 10, 16, 20), D("549.9900"), D("44.0000"), D("25.0000"), "Shipped"),
        (10004, 4, 102, datetime(2024, 2, 15, 8, 0), D("3249.9700"), D("260.0000"), D("100.0000"), "Pending"),
        (10005, 5, None, datetime(2024, 2, 20, 13, 30), D("199.9900"), D("16.0000"), D("0.0000"), "Cancelled"),
    ]
    return spark.createDataFrame(
        rows,
        "order_id int, customer_id int, employee_id int, order_date timestamp_ntz, subtotal decimal(19,4), "
        "tax_amount decimal(19,4), discount_amount decimal(19,4), order_status string",
    )


def order_items(spark):
    rows = [
        (10000, 1, 1000, 1, D("1299.99"), D("0.00")),
        (10001, 1, 1000, 1, D("1299.99"), D("0.00")),
        (10001, 2, 1003, 1, D("899.99"), None),
        (10003, 1, 1004, 1, D("549.99"), D("5.00")),
        (10004, 2, 1005, 1, D("349.99"), D("10.00")),
    ]
    return spark.createDataFrame(
        rows,
        "order_id int, line_number smallint, product_id int, quantity int, unit_price decimal(10,2), "
        "discount_pct decimal(5,2)",
    )


def audit_log(spark):
    rows = [
        (1, "INSERT", "customers", "1", None, '{"name": "Acme", "city": "NYC"}'),
        (2, "UPDATE", "customers", "1", '{"city": "NYC"}', '{"city": "Boston"}'),
        (3, "INSERT", "customers", "2", None, '{"name": "Beta"}'),
        (4, "DELETE", "customers", "2", '{"name": "Beta"}', None),
        (5, "UPDATE", "orders", "7", '{"status": "Pending"}', '{"status": null, "note": "x"}'),
        (6, "INSERT", "customers", "3", None, '{"name": "Old", "city": "LA"}'),
        (7, "DELETE", "customers", "3", None, None),
        (8, "INSERT", "customers", "3", None, '{"name": "New"}'),
    ]
    return spark.createDataFrame(
        rows,
        "log_id bigint, event_type string, table_name string, record_id string, old_values string, new_values string",
    )
