"""Column expressions: cleaning, dates, labels and formats. No function here runs a job."""
