"""Column functions (billing periods, text, money, JSON), SQL functions and the projection fence."""
