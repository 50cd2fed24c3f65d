"""The operators applied to the driver's tables; loomwork.catalog collects them."""
