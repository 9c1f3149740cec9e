"""millrace: table onboarding and analytics as plain DataFrame -> DataFrame operators on Spark."""
