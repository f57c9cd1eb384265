"""Portfolio, dividend-income and investment-return analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames (or takes and
returns Columns); nothing is computed on the driver.  All tables carry a
leading ``portfolio_id``.
"""

__version__ = "0.1.0"
